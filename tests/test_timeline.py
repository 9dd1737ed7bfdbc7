"""Chunks must not change any answer, however small they are cut."""

import random

import pytest
from pyspark.sql import Window, functions as F

from seriesweave.operators import profile, quality
from seriesweave.operators.generate import generate
from seriesweave.plans.timeline import Chunking, running_total, with_previous
from seriesweave.schema import STATES, STATISTICS

CHUNKINGS = [Chunking(), Chunking(100), Chunking(1000), Chunking(10**9)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(400):
        series = rng.choice(["hot"] * 6 + ["a", "b"])
        ts = None if rng.random() < 0.03 else float(rng.choice([rng.randrange(2000), 500]))
        data.append((series, ts, i, rng.choice([None, "x", "y", "z"])))
    return spark.createDataFrame(data, "series_id string, ts double, row_id long, mark string").cache()


@pytest.mark.parametrize("chunking", CHUNKINGS)
def test_previous_and_known_match_plain_windows(rows, chunking):
    w = Window.partitionBy("series_id").orderBy("ts", "row_id")
    expected = rows.select(
        "*",
        F.lag(F.struct("row_id", "mark")).over(w).alias("before"),
        F.last("mark", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("seen"),
    )
    got = with_previous(
        rows, ["series_id"], ["ts", "row_id"], {"before": F.struct("row_id", "mark")}, {"seen": F.col("mark")}, chunking
    )
    key = lambda r: r["row_id"]
    want, have = sorted(expected.collect(), key=key), sorted(got.collect(), key=key)
    assert [r["before"] for r in want] == [r["before"] for r in have]
    assert [r["seen"] for r in want if r["mark"]] == [r["seen"] for r in have if r["mark"]]


@pytest.mark.parametrize("chunking", CHUNKINGS)
def test_running_totals_match_plain_windows(rows, chunking):
    w = Window.partitionBy("series_id").orderBy("ts", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    expected = rows.withColumn("total", F.sum("row_id").over(w)).collect()
    got = running_total(rows, ["series_id"], ["ts", "row_id"], F.col("row_id"), "total", chunking).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected))


def _random_history(spark, seed):
    rng = random.Random(seed)
    texts = ["unavailable", None, "", "12kWh", "nan"]
    states, stats = [], []
    for i in range(300):
        series = rng.choice(["s1_new"] * 5 + ["s2_new"])
        ts = rng.randrange(40_000) + rng.choice([0, 0.25])
        state = rng.choice(texts) if rng.random() < 0.3 else str(rng.randrange(100))
        attrs = rng.choice([None, '{"last_reset":"2025-01-0%dT00:00:00+00:00"}' % rng.randrange(1, 4)])
        states.append((series, float(ts), i, state, attrs, None))
    for i in range(200):
        value = None if rng.random() < 0.2 else float(rng.randrange(50))
        stats.append(
            (rng.choice(["s1_old", "s2_old"]), "statistics", 3600, 3600.0 * rng.randrange(60), i, value, value, None, None, None, None, rng.choice([None, 1.0, 2.0]), None)
        )
    pairs = spark.createDataFrame(
        [("s1_old", "s1_new", "total", True), ("s2_old", "s2_new", "measurement", False)],
        "old_id string, new_id string, kind string, started_from_0 boolean",
    )
    return spark.createDataFrame(states, STATES), spark.createDataFrame(stats, STATISTICS), pairs


@pytest.mark.parametrize("chunking", CHUNKINGS[1:])
def test_operators_do_not_depend_on_chunks(spark, chunking):
    states, stats, pairs = _random_history(spark, 3)

    def results(c):
        frames = [
            profile.state_outages(states, chunking=c),
            profile.statistics_outages(stats, chunking=c),
            quality.missing_rows(stats, c),
            quality.state_resets(states, "total", c),
            quality.state_resets(states, chunking=c),
            quality.statistics_resets(stats, "total", chunking=c),
            generate(states, stats, pairs, run_ts=0.0, chunking=c),
        ]
        return [sorted(map(str, f.collect())) for f in frames]

    plain = results(Chunking())
    assert all(plain)
    assert results(chunking) == plain
