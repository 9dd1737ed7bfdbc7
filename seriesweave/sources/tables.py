"""Recorder tables of any age in, canonical DataFrames out.

Which columns a table has is known from its schema alone, so picking columns
costs no job. The id dictionaries and shared attributes are plain equi-joins:
Catalyst broadcasts a side when its size allows and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.times import text_epoch, text_epoch_utc
from ..schema import (
    INTERVALS,
    MARKS,
    STATE_TIME_COLUMNS,
    STATES,
    STATISTICS,
    STATISTICS_TIME_COLUMNS,
)
from .sinks import BUCKET, with_bucket


class TableError(ValueError):
    """A table that cannot be used for what was asked of it."""


def _first_of(df: DataFrame | None, names: Sequence[str]) -> str | None:
    present = [] if df is None else df.columns
    return next((n for n in names if n in present), None)


def _column(df: DataFrame, name: str | None, dtype: T.DataType) -> Column:
    """A column by name, cast leniently; typed NULL when the table lacks it."""
    return F.lit(None).cast(dtype) if name is None or name not in df.columns else F.col(name).try_cast(dtype)


def _epoch(df: DataFrame, name: str, text_zone: str) -> Column:
    field = df.schema[name].dataType
    if isinstance(field, T.TimestampNTZType):
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", start, F.col(name)) / F.lit(1e6)
    if isinstance(field, T.TimestampType):
        return F.unix_micros(name) / F.lit(1e6)
    if name.endswith("_ts") or not isinstance(field, T.StringType):
        return F.col(name).try_cast("double")
    return text_epoch_utc(F.col(name)) if text_zone == "utc" else text_epoch(F.col(name), None if text_zone == "local" else text_zone)


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def canonical_states(
    states: DataFrame,
    states_meta: DataFrame | None = None,
    state_attributes: DataFrame | None = None,
    *,
    attributes: str = "rebuild",
    text_zone: str = "local",
    strict: bool = False,
) -> DataFrame:
    """Raw state history as ``schema.STATES``.

    ``attributes`` chooses where the JSON payload comes from:

    - ``rebuild``: shared payload, with the inline one as fallback per field
    - ``detect``: shared payload only where it can be joined (rows without one
      are left out), else the inline column
    - ``probe``: inline payload, with the shared one as fallback
    - ``none``: no payload

    ``text_zone`` says how legacy text timestamps without a zone are read:
    ``local`` (the session zone), ``utc``, or the name of the zone of the site that wrote
    the table, so that sites of several zones can be united. A table without a usable id or time
    column gives no rows, or a ``TableError`` when ``strict``.
    """
    time = _first_of(states, STATE_TIME_COLUMNS)
    by_dictionary = "metadata_id" in states.columns and states_meta is not None
    if time is None or not (by_dictionary or "entity_id" in states.columns):
        if strict:
            raise TableError("states has no usable time or id column")
        return _empty(states.sparkSession, STATES)

    series = None if by_dictionary else F.col("entity_id").cast("string")
    rows = states.select(
        *([F.col("metadata_id")] if by_dictionary else [series.alias("series_id")]),
        _epoch(states, time, text_zone).alias("ts"),
        _column(states, _first_of(states, ("row_id", "state_id")), T.LongType()).alias("row_id"),
        _column(states, "state", T.StringType()).alias("state"),
        _column(states, "attributes_id", T.LongType()).alias("attributes_id"),
        _column(states, "attributes", T.StringType()).alias("_attributes"),
        _column(states, "shared_attrs", T.StringType()).alias("_shared_inline"),
    )
    if by_dictionary:
        names = states_meta.select("metadata_id", F.col("entity_id").cast("string").alias("series_id"))
        rows = rows.join(names, "metadata_id")
    rows = rows.where(F.col("series_id").isNotNull())

    shared, joined = _shared_payloads(states, state_attributes, attributes), False
    if shared is not None and attributes != "none":
        rows = rows.join(shared, "attributes_id", "inner" if attributes == "detect" else "left")
        joined = True

    null = F.lit(None).cast("string")
    payload = F.col("_shared") if joined else null
    if attributes == "rebuild":
        attrs, fallback = (payload, F.col("_attributes")) if joined else (F.col("_attributes"), null)
    elif attributes == "detect":
        attrs, fallback = (
            payload if joined else F.col("_shared_inline" if "shared_attrs" in states.columns else "_attributes")
        ), null
    elif attributes == "probe":
        inline = "_attributes" if joined or "attributes" in states.columns else "_shared_inline"
        attrs, fallback = F.coalesce(F.col(inline), payload), null
    else:
        attrs, fallback = null, null
    return rows.select(
        "series_id", "ts", "row_id", "state", attrs.alias("attrs"), fallback.alias("attrs_fallback")
    )


def _shared_payloads(
    states: DataFrame, state_attributes: DataFrame | None, attributes: str
) -> DataFrame | None:
    if state_attributes is None or "attributes_id" not in states.columns:
        return None
    # A rebuild knows only the current layout; looking at payloads accepts older ones.
    keys, values = (
        (("attributes_id",), ("shared_attrs",))
        if attributes == "rebuild"
        else (("attributes_id", "id"), ("shared_attrs", "attributes"))
    )
    key, value = _first_of(state_attributes, keys), _first_of(state_attributes, values)
    if key is None or value is None:
        return None
    return state_attributes.select(
        F.col(key).cast("bigint").alias("attributes_id"), F.col(value).cast("string").alias("_shared")
    )


def canonical_statistics(
    statistics: DataFrame,
    statistics_meta: DataFrame | None = None,
    *,
    table: str = "statistics",
    interval_s: int | None = None,
    text_zone: str = "local",
    strict: bool = False,
    layout: bool = False,
) -> DataFrame:
    """One statistics table as ``schema.STATISTICS``; union both for all operators.

    With ``layout`` rows also carry ``marks``, the form in which their table keeps reset marks:
    ``epoch`` where it has ``last_reset_ts``, else ``text``. Operators that look at marks go by it,
    so that tables of different ages can be united.
    """
    time = _first_of(statistics, STATISTICS_TIME_COLUMNS)
    by_dictionary = "metadata_id" in statistics.columns and statistics_meta is not None
    usable = time is not None and (
        {"id", "statistic_id"} <= set(statistics_meta.columns)
        if by_dictionary
        else "statistic_id" in statistics.columns
    )
    if not usable:
        if strict:
            raise TableError(f"{table} has no usable time or id column")
        empty = _empty(statistics.sparkSession, STATISTICS)
        return empty.withColumn(MARKS, F.lit("epoch")) if layout else empty

    rows = statistics.select(
        F.col("metadata_id") if by_dictionary else F.col("statistic_id").cast("string").alias("series_id"),
        F.lit(table).alias("table"),
        F.lit(interval_s or INTERVALS[table]).cast("bigint").alias("interval_s"),
        _epoch(statistics, time, text_zone).alias("start_ts"),
        _column(statistics, _first_of(statistics, ("row_id", "id")), T.LongType()).alias("row_id"),
        *(
            _column(statistics, f.name, f.dataType).alias(f.name)
            for f in STATISTICS.fields
            if f.name not in ("series_id", "table", "interval_s", "start_ts", "row_id")
        ),
    )
    if by_dictionary:
        names = statistics_meta.select(
            F.col("id").alias("metadata_id"), F.col("statistic_id").cast("string").alias("series_id")
        )
        rows = rows.join(names, "metadata_id").drop("metadata_id")
    rows = rows.where(F.col("series_id").isNotNull()).select(*STATISTICS.fieldNames())
    return rows.withColumn(MARKS, F.lit("epoch" if "last_reset_ts" in statistics.columns else "text")) if layout else rows


def only_series(df: DataFrame, wanted: DataFrame, column: str = "series_id", buckets: int | None = None) -> DataFrame:
    """Rows of the wanted series; Catalyst broadcasts ``wanted`` when it is small enough.

    With ``buckets``, the number that ``write_bucketed`` laid ``df`` out by, the wanted series' buckets are
    partition filters too: where ``wanted`` is broadcast, no file of another bucket is read.
    """
    ids = wanted.select(F.col(column).alias("series_id"))
    if buckets is None:
        return df.join(ids, "series_id", "left_semi")
    # Spark prunes partitions only by a side that has a filter of its own; all bucket numbers pass this one.
    ids = with_bucket(ids, buckets).where(F.col(BUCKET) >= 0)
    return df.join(ids, [BUCKET, "series_id"], "left_semi")


def jdbc_options(url: str, table: str, key: str, low: int, high: int, partitions: int, **more: str) -> dict:
    """Options of a JDBC read that is split into key ranges, one query per task."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
        **more,
    }


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    """Read a recorder table over JDBC; see ``jdbc_options``."""
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()
