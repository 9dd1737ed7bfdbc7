"""Sensor tables derived from the test tables by plain projections and one roll-up.

``events`` become readings of a counter that starts anew every day: tenths of
seconds since midnight plus the event's value in cents, so it mostly rises, dips
a little now and then, and falls at midnight. An ``error`` event is an outage,
written in one of four ways. Every user is a sensor that was replaced on
16 January; alternatively every event type is one, which gives five series that
hold all rows. ``customer`` rows become registry entries of such sensor pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import bucket
from ..schema import INTERVALS, STATISTICS

CHANGE = "2024-01-16 00:00:00"
RUN_TS = 1_706_745_600.0
FIRST_DAY = 1_704_067_200
ZONES = ("America/New_York", "Asia/Kolkata", "Europe/Berlin")


# Naming the columns saves a job that looks them up.
_COLUMNS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[table]).parquet(f"{sf_dir}/{table}.parquet")


def sensor(by: str = "user") -> Column:
    name = F.concat(F.lit("sensor.u"), F.col("user_id").cast("string")) if by == "user" else F.concat(F.lit("sensor."), "event_type")
    half = F.when(F.col("ts") < F.lit(CHANGE).cast("timestamp_ntz"), "_old").otherwise("_new")
    return F.concat(name, half)


def epoch(ts: Column) -> Column:
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts) / F.lit(1e6)


def _readings(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(
        sensor(by).alias("series_id"),
        epoch(F.col("ts")).alias("ts"),
        F.col("event_id").alias("row_id"),
        "event_type",
        F.to_date("ts").cast("string").alias("day"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    counter = (F.floor("ts").cast("bigint") % 86_400) * 10 + F.col("cents")
    return rows.withColumn("counter", counter).withColumn(
        "with_unit", (F.col("event_type") == "signup") & (F.col("cents") % 10 == 0)
    )


def states(spark: SparkSession, sf_dir: str, by: str = "user") -> DataFrame:
    written = F.col("row_id") % 4
    outage = F.when(written == 0, "unavailable").when(written == 2, "").when(written == 3, " Unknown ")
    text = F.col("counter").cast("string")
    return _readings(spark, sf_dir, by).select(
        "series_id",
        "ts",
        "row_id",
        F.when(F.col("event_type") == "error", outage)
        .when(F.col("with_unit"), F.concat(text, F.lit(" kWh")))
        .otherwise(text)
        .alias("state"),
        F.when(
            F.col("event_type") != "view",
            F.concat(F.lit('{"last_reset":"'), "day", F.lit('T00:00:00+00:00"}')),
        ).alias("attrs"),
        F.lit(None).cast("string").alias("attrs_fallback"),
    )


def statistics(spark: SparkSession, sf_dir: str, by: str = "user") -> DataFrame:
    """Both statistics tables; hours without events are real gaps."""
    value = F.when((F.col("event_type") != "error") & ~F.col("with_unit"), F.col("counter").cast("double"))
    grains = F.array(
        *(F.struct(F.lit(t).alias("table"), F.lit(i).cast("bigint").alias("interval_s")) for t, i in INTERVALS.items())
    )
    rows = (
        _readings(spark, sf_dir, by)
        .select("series_id", "ts", "row_id", value.alias("v"), F.explode(grains).alias("grain"))
        .select("series_id", "ts", "row_id", "v", "grain.*")
    )
    start = F.col("start")
    return (
        rows.groupBy("series_id", "table", "interval_s", bucket("ts", F.col("interval_s")).alias("start"))
        .agg(
            F.min("row_id").alias("row_id"),
            F.max("row_id").alias("last_row"),
            F.max_by("v", F.when(F.col("v").isNotNull(), F.col("ts"))).alias("state"),
            F.avg("v").alias("mean"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
        )
        .select(
            "series_id",
            "table",
            "interval_s",
            start.cast("double").alias("start_ts"),
            "row_id",
            "state",
            (F.floor((start - FIRST_DAY) / 10) + F.col("max")).alias("sum"),
            "mean",
            "min",
            "max",
            F.lit(None).cast("string").alias("last_reset"),
            F.when(F.col("last_row") % 3 != 0, (start - start % 86_400).cast("double")).alias("last_reset_ts"),
            (start + F.col("interval_s")).cast("double").alias("created_ts"),
        )
        .select(*STATISTICS.fieldNames())
    )


def replacements(
    spark: SparkSession, sf_dir: str, kind: str | None = "total_increasing", from_zero: bool = False, by: str = "user"
) -> DataFrame:
    """One pair per sensor with events on both sides; mixed kinds by user when ``kind`` is None."""
    name = "user_id" if by == "user" else "event_type"
    events = _read(spark, sf_dir, "events")
    change = F.lit(CHANGE).cast("timestamp_ntz")
    label = F.concat(F.lit("sensor.u"), F.col(name).cast("string")) if by == "user" else F.concat(F.lit("sensor."), name)
    mixed = (
        F.when(F.col(name) % 3 == 0, "total_increasing").when(F.col(name) % 3 == 1, "total").otherwise("measurement")
        if kind is None
        else F.lit(kind)
    )
    return (
        events.groupBy(name)
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
        .where((F.col("first") < change) & (F.col("last") >= change))
        .select(
            F.concat(label, F.lit("_old")).alias("old_id"),
            F.concat(label, F.lit("_new")).alias("new_id"),
            mixed.alias("kind"),
            F.lit(from_zero).alias("started_from_0"),
        )
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for every sensor of every user."""
    user = F.col("user_id")
    kind = F.when(user % 3 == 0, "total_increasing").when(user % 3 == 1, "total").otherwise("measurement")
    # Some successors got another class than their predecessor.
    new_kind = F.when(user % 10 == 7, "measurement").otherwise(kind)
    side = lambda half, k: F.struct(
        F.concat(F.lit("sensor.u"), user.cast("string"), F.lit(half)).alias("series_id"), k.alias("state_class")
    )
    return (
        _read(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .select(F.explode(F.array(side("_old", kind), side("_new", new_kind))).alias("c"))
        .select("c.*")
    )


def registry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry per customer with an old and a new sensor; some are not valid."""
    key = F.col("c_custkey")
    text_key = key.cast("string")
    nation = F.col("c_nationkey").cast("bigint")

    def entry(half: str) -> Column:
        old = half == "old"
        return F.struct(
            F.concat(F.lit("sensor.c"), text_key, F.lit(f"_{half}")).alias("entity_id"),
            F.concat(F.lit("u"), text_key).alias("unique_id"),
            F.lower("c_mktsegment").alias("platform"),
            F.when(nation % 3 != 0, F.concat(F.lit("area"), nation.cast("string"))).alias("area_id"),
            F.lit("meter" if old else "Meter").alias("name"),
            F.struct(
                F.when(key % 5 != 0, F.lit("total_increasing" if old else "measurement")).alias("state_class")
            ).alias("capabilities"),
            F.lit("total").alias("original_state_class"),
            F.struct(nation.alias("a"), (nation if old else nation + key % 2).alias("b")).alias("options"),
            (F.array(F.lit("a"), text_key) if old else F.array(F.lit("a"))).alias("aliases"),
            (F.lit(True) if old else key % 2 == 0).alias("has_entity_name"),
        )

    keep = {"ignoreNullFields": "false"}
    doc = F.to_json(F.struct(F.struct(F.array(entry("old"), entry("new")).alias("entities")).alias("data")), keep)
    # Documents are some hundred times as long as the stored rows that they are made of: few files make many of them.
    customers = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    customers = customers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return customers.select(
        text_key.alias("site"),
        F.when(key % 50 == 17, F.substring(doc, 1, 40))
        .when(key % 50 == 18, F.lit('{"data":{}}'))
        .when(key % 50 == 19, F.lit("[]"))
        .otherwise(doc)
        .alias("doc"),
    )


def customer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_key = F.col("c_custkey").cast("string")
    return _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("sensor.c"), text_key, F.lit("_old")).alias("old_id"),
        F.concat(F.lit("sensor.c"), text_key, F.lit("_new")).alias("new_id"),
    )


def recorder_states(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The readings in the layout with id and attribute dictionaries."""
    events = _read(spark, sf_dir, "events")
    rows = states(spark, sf_dir).join(events.select(F.col("event_id").alias("row_id"), "user_id", F.to_date("ts").alias("d")), "row_id")
    day = F.datediff("d", F.lit("2024-01-01").cast("date")).cast("bigint")
    half = F.when(F.col("series_id").endswith("_old"), 0).otherwise(1)
    payload = F.concat(F.lit('{"last_reset":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('T00:00:00+00:00"}'))
    return {
        "states": rows.select(
            F.col("row_id").alias("state_id"),
            (F.col("user_id") * 2 + half).alias("metadata_id"),
            "state",
            F.col("ts").alias("last_updated_ts"),
            F.when(F.col("attrs").isNotNull(), day).alias("attributes_id"),
            F.when(F.col("row_id") % 2 == 0, F.lit('{"last_reset":"2020-01-01T00:00:00Z"}')).alias("attributes"),
        ),
        "states_meta": events.select("user_id")
        .distinct()
        .select(
            F.explode(
                F.array(
                    *(
                        F.struct(
                            (F.col("user_id") * 2 + n).alias("metadata_id"),
                            F.concat(F.lit("sensor.u"), F.col("user_id").cast("string"), F.lit(s)).alias("entity_id"),
                        )
                        for n, s in enumerate(("_old", "_new"))
                    )
                )
            ).alias("m")
        )
        .select("m.*"),
        "state_attributes": events.select(
            F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("attributes_id"),
            payload.alias("shared_attrs"),
        ).distinct(),
    }


def legacy_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings with ids inline and times as text."""
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("state_id"),
        sensor().alias("entity_id"),
        F.round(F.col("value") * 100).cast("bigint").cast("string").alias("state"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        F.col("props").alias("attributes"),
    )


def recorder_statistics(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Both statistics tables in the layout with an id dictionary and text reset marks."""
    rows = statistics(spark, sf_dir)
    key = F.substring_index(F.substring("series_id", 9, 40), "_", 1).cast("bigint") * 2
    stored = {
        table: rows.where(F.col("table") == table).select(
            F.col("row_id").alias("id"),
            (key + F.when(F.col("series_id").endswith("_old"), 0).otherwise(1)).alias("metadata_id"),
            "start_ts",
            "state",
            "sum",
            F.date_format(F.timestamp_seconds("last_reset_ts"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("last_reset"),
        )
        for table in INTERVALS
    }
    return stored | {
        "statistics_meta": recorder_states(spark, sf_dir)["states_meta"].select(
            F.col("metadata_id").alias("id"), F.col("entity_id").alias("statistic_id")
        ),
    }


def at_newer_site() -> Column:
    """Series of users with an even number."""
    return F.substring_index(F.substring("series_id", 9, 40), "_", 1).cast("bigint") % 2 == 0
