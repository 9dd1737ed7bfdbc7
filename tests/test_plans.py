"""The physical plans have the shape the operators are designed for."""

import re

import pytest
from pyspark.sql import functions as F

from seriesweave.operators import diff, profile, quality, splice
from seriesweave.operators.generate import generate
from seriesweave.schema import REPLACEMENTS, STATES, STATISTICS


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name, schema in (("states", STATES), ("statistics", STATISTICS), ("pairs", REPLACEMENTS)):
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
    return tuple(spark.read.parquet(f"{root}/{n}") for n in ("states", "statistics", "pairs"))


def plan(spark, build):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


NEIGHBOURS = {
    "missing_rows": lambda st, s, p: quality.missing_rows(s),
    "state_resets": lambda st, s, p: quality.state_resets(st),
    "state_resets_total": lambda st, s, p: quality.state_resets(st, "total"),
    "state_resets_by_class": lambda st, s, p: quality.state_resets(st.withColumn("k", F.lit("total")), F.col("k")),
    "statistics_resets": lambda st, s, p: quality.statistics_resets(s),
    "statistics_resets_total": lambda st, s, p: quality.statistics_resets(s, "total"),
    "statistics_resets_text": lambda st, s, p: quality.statistics_resets(s, "total", "text"),
    "state_outages": lambda st, s, p: profile.state_outages(st),
    "statistics_outages": lambda st, s, p: profile.statistics_outages(s),
}


@pytest.mark.parametrize("name", [n for n in NEIGHBOURS if "outages" not in n])
def test_rows_are_shuffled_once_by_chunk(spark, tables, name):
    text = plan(spark, lambda: NEIGHBOURS[name](*tables))
    by_chunk = [l for l in text.splitlines() if re.search(r"- Exchange hashpartitioning\(.*_cell", l)]
    assert len(by_chunk) == 1
    assert "ReusedExchange" in text
    assert "Python" not in text and "CartesianProduct" not in text


def test_summary_combines_before_the_only_shuffle(spark, tables):
    text = plan(spark, lambda: profile.summarize_states(tables[0]))
    assert text.count("Exchange") == 1 and "partial_min" in text


def test_resets_read_only_what_they_need(spark, tables):
    text = plan(spark, lambda: quality.state_resets(tables[0]))
    assert "attrs" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_states_are_shuffled_once_for_both_tables(spark, tables):
    text = plan(spark, lambda: generate(*tables))
    assert len(re.findall(r"- Exchange hashpartitioning\(series_id#\d+, _cell", text)) == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_diff_shuffles_once(spark, tables):
    text = plan(spark, lambda: diff.change_report(tables[1], tables[1]))
    assert text.count("Exchange hashpartitioning") == 1


JOINED = {
    **NEIGHBOURS,
    "generate": lambda st, s, p: generate(st, s, p),
    "reset_report": lambda st, s, p: quality.reset_report(st, s, p.select(F.col("new_id").alias("series_id"), F.col("kind").alias("state_class"))),
    "generated_resets": lambda st, s, p: splice.quality_checks(generate(st, s, p), p)["resets"],
}


@pytest.mark.parametrize("name", JOINED)
def test_cells_are_dealt_out_under_any_join(spark, tables, name):
    """Also where no side of a join is small, so that rows arrive dealt out by series."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, lambda: JOINED[name](*tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"- Exchange hashpartitioning\(.*_cell", text)


@pytest.mark.parametrize("name", ["state_outages", "statistics_outages"])
def test_outage_runs_read_and_shuffle_rows_once(spark, tables, name):
    text = plan(spark, lambda: NEIGHBOURS[name](*tables))
    live = [l for l in text.splitlines() if "Reused" not in l]
    assert sum("_cell" in l and "Exchange hashpartitioning" in l for l in live) == 1
    assert "Join" not in text and "SortAggregate" not in text


@pytest.mark.parametrize("name", ["state_outages", "statistics_outages"])
def test_tasks_of_outage_runs_are_not_joined_by_packed_size(spark, tables, name):
    """Rows are unpacked into sorts and hash tables, so tasks of some 64 MB each would take gigabytes."""
    text = plan(spark, lambda: NEIGHBOURS[name](*tables))
    shuffles = [l for l in text.splitlines() if re.search(r"- Exchange hashpartitioning", l)]
    assert shuffles and all("REPARTITION_BY_NUM" in l for l in shuffles)


@pytest.mark.parametrize("name", ["state_outages", "statistics_outages"])
def test_outage_runs_keep_their_partitions(spark, states, statistics, name):
    rows = states(*(("sensor.a", i * 40_000, None) for i in range(40)))
    long = statistics([{"series_id": "sensor.a", "start_ts": i * 36_000} for i in range(40)])
    runs = profile.state_outages(rows) if name == "state_outages" else profile.statistics_outages(long)
    # Those of inner segments and those of merged ones; none are joined, small as they are.
    assert runs.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [r.row_count for r in runs.collect()] == [40]


def test_planning_starts_no_job(spark, tables):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    for build in JOINED.values():
        build(*tables)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
