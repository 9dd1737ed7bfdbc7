"""Canonical table layouts and the fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: results depend on these exact words and numbers. ---------

# State texts that mean "no reading" (compared trimmed and in lower case).
UNAVAILABLE_TEXTS = ("unavailable", "unknown")

# Statistics tables and the distance of their rows in seconds.
INTERVALS = {"statistics": 3600, "statistics_short_term": 300}

# Value columns in the order used to decide whether a row has any value, and
# in the order used to choose the value shown for a row.
VALUE_COLUMNS = ("state", "sum", "mean", "min", "max")
DISPLAY_COLUMNS = ("state", "mean", "min", "max", "sum")

# Kinds of sensors whose statistics can be rebuilt.
KINDS = ("total_increasing", "total", "measurement")
TOTAL_KINDS = ("total_increasing", "total")

# A counter counts as reset when it falls below this share of its last value.
RESET_RATIO = 0.9

# Rows are missing when two neighbours are further apart than this many intervals.
GAP_FACTOR = 1.5

# Columns whose change alone does not make a changed row worth keeping.
TRIVIAL_CHANGES = ("sum", "created_ts")

# Changed rows always kept at either end of a contiguous block.
BLOCK_EDGE = 3

# Attributes listed first in an attribute comparison.
LEADING_ATTRIBUTES = (
    "entity_id",
    "id",
    "unique_id",
    "platform",
    "config_entry_id",
    "config_subentry_id",
    "device_id",
    "area_id",
    "name",
    "original_name",
    "icon",
    "original_icon",
    "disabled_by",
    "hidden_by",
    "entity_category",
    "has_entity_name",
    "device_class",
    "original_device_class",
    "unit_of_measurement",
    "supported_features",
    "translation_key",
    "previous_unique_id",
    "created_at",
    "modified_at",
)

# Column preferences when reading tables of different ages.
STATE_TIME_COLUMNS = ("last_updated_ts", "last_changed_ts", "last_updated", "last_changed")
STATISTICS_TIME_COLUMNS = ("start_ts", "start")

# --- Canonical layouts ------------------------------------------------------

STATES = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("attrs", T.StringType()),
        T.StructField("attrs_fallback", T.StringType()),
    ]
)

STATISTICS = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("interval_s", T.LongType()),
        T.StructField("start_ts", T.DoubleType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("state", T.DoubleType()),
        T.StructField("sum", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("last_reset", T.StringType()),
        T.StructField("last_reset_ts", T.DoubleType()),
        T.StructField("created_ts", T.DoubleType()),
    ]
)

# Optional column of statistics rows: ``epoch`` or ``text``, how their table keeps reset marks.
MARKS = "marks"

REPLACEMENTS = T.StructType(
    [
        T.StructField("old_id", T.StringType()),
        T.StructField("new_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("started_from_0", T.BooleanType()),
    ]
)
