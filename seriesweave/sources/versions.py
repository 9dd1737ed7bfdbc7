"""Both stored statistics tables behind one version pointer, replaced in one step.

Below ``root`` lie ``data/<version>/<table>/series_bucket=<n>/``, never changed once written, and
``CURRENT.json``, which names for every table and bucket the folder that holds it. A replacement
writes the buckets of the replaced series, of both tables, to folders of a new version and then
renames a new pointer over the old one. Readers resolve the pointer, so they see all of a change
or none of it; a job that fails before the rename leaves the old version as it is, and running
it again is safe. Folders that no pointer names any more are left for the caller to remove.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .sinks import BUCKET, as_target_rows

POINTER = "CURRENT.json"


def _key(table: DataFrame) -> str:
    return "metadata_id" if "metadata_id" in table.columns else "statistic_id"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointer(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0])


def _switch(spark: SparkSession, root: str, pointer: dict, before: str | None) -> None:
    """Rename the new pointer over the old one, which must still be that of version ``before``."""
    own, system = _system(spark, f"{root}/{POINTER}.{pointer['version']}")
    out = system.create(own, True)
    out.write(bytearray(json.dumps(pointer), "utf-8"))
    out.close()
    place, _ = _system(spark, f"{root}/{POINTER}")
    now = _pointer(spark, root)["version"] if system.exists(place) else None
    if now != before:
        system.delete(own, False)
        raise RuntimeError(f"{root} is at version {now} by now, not {before}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(own.toUri(), spark._jsc.hadoopConfiguration()).rename(own, place, options)


def _written(spark: SparkSession, rows: DataFrame, folder: str, buckets: int) -> dict[str, str]:
    """Write rows by bucket; the folders that came of it, by bucket. Their number is bounded by the layout."""
    placed = rows.withColumn(BUCKET, _bucket(_key(rows), buckets)).hint("rebalance", BUCKET)
    placed.write.mode("errorifexists").partitionBy(BUCKET).parquet(folder)
    place, system = _system(spark, folder)
    names = (status.getPath().getName() for status in system.listStatus(place))
    return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def create(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], buckets: int) -> str:
    """Write the first version of stored tables, by name; fails where there is one already."""
    version = uuid.uuid4().hex
    pointer = {"version": version, "buckets": buckets, "tables": {}}
    for name, rows in tables.items():
        folders = _written(spark, rows, f"{root}/data/{version}/{name}", buckets)
        pointer["tables"][name] = {"schema": rows.schema.json(), "folders": folders}
    _switch(spark, root, pointer, None)
    return version


def _read(spark: SparkSession, table: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(table["schema"]))
    folders = [f for b, f in sorted(table["folders"].items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version. Frames keep to it when a later version is switched to."""
    return {name: _read(spark, table) for name, table in _pointer(spark, root)["tables"].items()}


def replace(
    spark: SparkSession,
    root: str,
    generated: DataFrame,
    replaced: DataFrame,
    statistics_meta: DataFrame | None = None,
    run_ts: float | None = None,
) -> str:
    """Put ``generated`` (canonical rows) in place of all rows of ``replaced(new_id)``, in every table at once.

    Ids are looked up, old rows left out and new ones added in the layout that each table has; a
    successor without an id in ``statistics_meta`` fails the write. Only buckets of replaced
    series are read and written. Returns the new version.
    """
    pointer = _pointer(spark, root)
    before, buckets, version = pointer["version"], pointer["buckets"], uuid.uuid4().hex
    ids = replaced.select(F.col("new_id").alias("series_id")).distinct()
    generated = generated.join(ids, "series_id", "left_semi")
    for name, table in pointer["tables"].items():
        target = spark.createDataFrame([], StructType.fromJson(json.loads(table["schema"])))
        key = _key(target)
        if key == "metadata_id":
            if statistics_meta is None:
                raise ValueError(f"{name} stores dictionary keys: statistics_meta is required")
            known = statistics_meta.select(F.col("id").alias(key), F.col("statistic_id").alias("series_id"))
            keys = known.join(ids, "series_id", "left_semi").select(F.col(key).cast(target.schema[key].dataType).alias(key))
        else:
            keys = ids.select(F.col("series_id").alias(key))
        fresh = as_target_rows(generated.where(F.col("table") == name), target, statistics_meta, run_ts)
        # Numbers of buckets only, so the layout bounds them; all ids that are written count, known or not.
        touched = {str(r[0]) for r in keys.select(_bucket(key, buckets)).distinct().collect()}
        kept = _read(spark, table, sorted(touched)).join(keys, key, "left_anti")
        rows = kept.unionByName(fresh, allowMissingColumns=True).select(*target.columns)
        folders = _written(spark, rows, f"{root}/data/{version}/{name}", buckets)
        table["folders"] = {b: f for b, f in table["folders"].items() if b not in touched} | folders
    pointer["version"] = version
    _switch(spark, root, pointer, before)
    return version
