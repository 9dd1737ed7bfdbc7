"""Replacing series in both stored tables: all of it or nothing."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seriesweave.operators.generate import generate
from seriesweave.sources import versions
from seriesweave.sources.tables import canonical_statistics

TABLES = {"statistics": 3600, "statistics_short_term": 300}


@pytest.fixture
def stored(spark, tmp_path):
    """40 series in two tables that keep dictionary keys, as version one."""
    layout = "id long, metadata_id long, start_ts double, state double, sum double, created_ts double"
    rows = lambda step: [(100 * m + n, m, float(n * step), 1.0 * n, 10.0 * n + m, 1.0) for m in range(40) for n in range(3)]
    tables = {t: spark.createDataFrame(rows(step), layout) for t, step in TABLES.items()}
    meta = spark.createDataFrame([(m, f"sensor.s{m}") for m in range(40)], "id long, statistic_id string")
    root = f"{tmp_path}/stored"
    first = versions.create(spark, root, tables, 16)
    return root, first, meta


def contents(spark, root):
    return {t: sorted(map(tuple, df.drop("id").collect())) for t, df in versions.read(spark, root).items()}


def replacement(spark, root, meta, states):
    canonical = [canonical_statistics(df, meta, table=t) for t, df in versions.read(spark, root).items()]
    statistics = canonical[0].unionByName(canonical[1])
    pairs = spark.createDataFrame([("sensor.s1", "sensor.s2", "total_increasing", True)], "old_id string, new_id string, kind string, started_from_0 boolean")
    readings = states(("sensor.s2", 20_000, "5"), ("sensor.s2", 20_400, "7"), ("sensor.s2", 24_000, "9"))
    return generate(readings, statistics, pairs, TABLES, run_ts=9.0), pairs


def test_both_tables_change_together(spark, stored, states):
    root, first, meta = stored
    old = contents(spark, root)
    frames = versions.read(spark, root)
    generated, pairs = replacement(spark, root, meta, states)
    expected = {t: {(r.start_ts, r.sum) for r in generated.where(F.col("table") == t).collect()} for t in TABLES}
    second = versions.replace(spark, root, generated, pairs, meta, 9.0)
    new = contents(spark, root)
    for t in TABLES:
        assert [r for r in new[t] if r[0] != 2] == [r for r in old[t] if r[0] != 2]
        assert {(r[1], r[3]) for r in new[t] if r[0] == 2} == expected[t] and len(expected[t]) > 3
        # A reader that resolved the old pointer still has its rows.
        assert sorted(map(tuple, frames[t].drop("id").collect())) == old[t]
    # Other buckets were not written again.
    folders = [f for t in json.loads(Path(root, versions.POINTER).read_text())["tables"].values() for f in t["folders"].values()]
    assert first != second and sum(first in f for f in folders) > 3 * sum(second in f for f in folders) > 0


def test_a_failure_in_the_middle_changes_nothing(spark, stored, states):
    root, first, meta = stored
    old = contents(spark, root)
    generated, pairs = replacement(spark, root, meta, states)
    # The first table is written, rows of the second fail.
    breaks = F.when(F.col("table") == "statistics_short_term", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("sum"))
    with pytest.raises(Exception, match="lost"):
        versions.replace(spark, root, generated.withColumn("sum", breaks), pairs, meta, 9.0)
    assert contents(spark, root) == old
    versions.replace(spark, root, generated, pairs, meta, 9.0)
    once = contents(spark, root)
    assert once != old
    # Done again from the same predecessor it gives the same.
    generated, pairs = replacement(spark, root, meta, states)
    versions.replace(spark, root, generated, pairs, meta, 9.0)
    assert contents(spark, root) == once


def test_unknown_ids_and_late_writers(spark, stored, states):
    root, first, meta = stored
    generated, pairs = replacement(spark, root, meta, states)
    with pytest.raises(Exception, match="no target id"):
        versions.replace(spark, root, generated, pairs, meta.where("id <> 2"), 9.0)
    with pytest.raises(RuntimeError, match="by now"):
        versions._switch(spark, root, {"version": "x", "buckets": 16, "tables": {}}, "another")
    with pytest.raises(RuntimeError, match="by now"):
        versions.create(spark, root, {}, 4)
    assert json.loads(Path(root, versions.POINTER).read_text())["version"] == first
