"""Putting rebuilt statistics in place of a series' old ones."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, functions as F

from ..plans.runs import as_runs, is_runs

BUCKET = "series_bucket"


def replace_series(
    target: DataFrame, generated: DataFrame, replaced: DataFrame, tables: Collection[str] | None = None
) -> DataFrame:
    """The target with all rows of the replaced series swapped for the generated ones.

    ``replaced(new_id)``; generated rows of other series are not taken. Rows of
    statistics tables other than ``tables`` stay as they are. If the generated rows are runs, so
    is the result.
    """
    ids = replaced.select(F.col("new_id").alias("_replaced"))
    hit = F.col("series_id") == F.col("_replaced")
    gone = hit if tables is None else hit & F.col("table").isin(*tables)
    if is_runs(generated):
        target = as_runs(target)
    kept = target.join(ids, gone, "left_anti")
    added = generated.join(ids, hit, "left_semi").select(*target.columns)
    return kept.unionByName(added)


def without_target_id(replacements: DataFrame, statistics_meta: DataFrame) -> DataFrame:
    """Pairs whose successor has no entry in the id dictionary; they cannot be written."""
    ids = statistics_meta.select(F.col("statistic_id").alias("new_id"))
    return replacements.join(ids, "new_id", "left_anti").withColumn("reason", F.lit("no target id"))


def as_target_rows(
    rows: DataFrame, target: DataFrame, statistics_meta: DataFrame | None = None, run_ts: float | None = None
) -> DataFrame:
    """Canonical rows in the columns of a stored statistics table, whichever layout it has.

    Only columns the table has are filled; a dictionary key is looked up by id, and an
    id that is not there fails the write (``eligibility`` tells such pairs beforehand);
    a text ``start`` is written in UTC where there is no ``start_ts``, and so is a
    reset mark where the table keeps only the text; rows without ``created_ts`` get
    the run time.
    """
    if "metadata_id" in target.columns:
        if statistics_meta is None:
            raise ValueError("the table stores dictionary keys: statistics_meta is required")
        keys = statistics_meta.select(F.col("id").alias("metadata_id"), F.col("statistic_id").alias("series_id"))
        rows = rows.join(keys, "series_id", "left")
        missing = F.raise_error(F.concat(F.lit("no target id: "), F.coalesce("series_id", F.lit("NULL"))))
        rows = rows.withColumn("metadata_id", F.coalesce("metadata_id", missing.cast("bigint")))
    else:
        rows = rows.withColumn("statistic_id", F.col("series_id"))
    now = F.lit(run_ts) if run_ts is not None else F.unix_seconds(F.current_timestamp())
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    second = F.make_dt_interval(secs=F.floor("start_ts").cast("decimal(18,6)"))
    marked = F.make_dt_interval(secs=F.floor("last_reset_ts").cast("decimal(18,6)"))
    rows = rows.withColumns(
        {
            "created_ts": F.coalesce("created_ts", now.cast("double")),
            "start": F.date_format(epoch + second, "yyyy-MM-dd HH:mm:ss"),
        }
    )
    if "last_reset_ts" not in target.columns:
        as_text = F.date_format(epoch + marked, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
        rows = rows.withColumn("last_reset", F.coalesce("last_reset", as_text))
    if "start_ts" in target.columns:
        rows = rows.drop("start")
    filled = [f for f in target.schema.fields if f.name in rows.columns]
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in filled))


def with_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """Add the partition column of a table that is laid out by series bucket."""
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int"))


def _layout(rows: DataFrame) -> list[str]:
    """Partition columns: states have no ``table``."""
    return [c for c in ("table", BUCKET) if c in (*rows.columns, BUCKET)]


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows of a partition in few tasks, so that it gets few files; adaptive execution splits large ones."""
    return rows.hint("rebalance", *_layout(rows))


def staged(rows: DataFrame, path: str) -> DataFrame:
    """Rows written once below ``path``; read back by whoever uses them.

    A finished stage is marked by Spark's ``_SUCCESS`` file and read as it is; an unfinished one,
    from a job that failed, is overwritten.
    """
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def write_version(rows: DataFrame, path: str) -> None:
    """Write a complete version to a new path; fails if something is there already."""
    rows.write.mode("errorifexists").parquet(path)


def write_bucketed(rows: DataFrame, path: str, buckets: int) -> None:
    """Write states or statistics laid out by series bucket, so that a few series are found and swapped in few files."""
    placed = _gathered(with_bucket(rows, buckets))
    placed.write.mode("errorifexists").partitionBy(*_layout(rows)).parquet(path)


def swap_in_place(
    path: str,
    generated: DataFrame,
    replaced: DataFrame,
    buckets: int,
    staging: str,
    tables: Collection[str] | None = None,
) -> None:
    """Replace series inside a table written by ``write_bucketed``.

    Only partitions that may hold a replaced series are read and rewritten, both
    statistics tables in one write. A job cannot overwrite what it reads, so the new
    content is written to ``staging`` first, a new folder that all machines share. The
    lists the driver sees hold partition names, so the layout bounds them. Readers may
    see the change half done; write a new version and switch to it where that matters.
    """
    spark = generated.sparkSession
    layout = ["table", BUCKET]
    ids = with_bucket(replaced.select(F.col("new_id").alias("series_id")), buckets)
    touched = [r[0] for r in ids.select(BUCKET).distinct().collect()]
    if not touched:
        return
    current = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    fresh = with_bucket(replace_series(current.drop(BUCKET), generated, replaced, tables), buckets)
    _gathered(fresh).write.mode("errorifexists").parquet(staging)
    fresh = spark.read.schema(fresh.schema).parquet(staging)
    # Dynamic overwrite leaves partitions alone that get no rows: empty those by name.
    emptied = current.select(*layout).distinct().join(fresh.select(*layout).distinct(), layout, "left_anti").collect()
    write = fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    write.partitionBy(*layout).parquet(path)
    for table, bucket in emptied:
        nothing = fresh.drop(*layout).where(F.lit(False))
        nothing.write.mode("overwrite").parquet(f"{path}/table={table}/{BUCKET}={bucket}")
