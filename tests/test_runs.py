"""Runs stand for the same rows, and operators give the same answers on both."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seriesweave.operators import diff, quality, splice
from seriesweave.operators.generate import generate, generate_runs, generated_counts, preview
from seriesweave.plans.runs import dealt, expand, is_runs, later_than


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def histories(states, statistics, pairs):
    """A successor that begins while its predecessor still has rows, with long gaps and two readings of a kind."""
    rng = random.Random(5)
    readings, ts = [], 7000
    for _ in range(60):
        ts += rng.choice([40, 300, 900, 4000, 30_000, 400_000])
        readings.append(("sensor.new", ts, str(rng.randint(0, 9)) if rng.random() < 0.9 else "unknown"))
    old = [{"start_ts": t, "state": rng.randint(0, 9), "sum": t // 100} for t in range(0, 18_000, 3600)]
    new = [{"start_ts": t, "state": rng.randint(0, 9), "sum": 5, "series_id": "sensor.new"} for t in range(3600, 90_000, 3600)]
    short = [{"start_ts": t, "state": 1, "sum": 1} for t in range(0, 9000, 300)]
    stored = statistics(old + new).unionByName(statistics(short, "statistics_short_term"))
    return states(*readings), stored, pairs(zero=True)


@pytest.fixture(scope="module")
def both(histories, tmp_path_factory, spark):
    """generate() and generate_runs(), written so that every test reads the same."""
    root = tmp_path_factory.mktemp("generated")
    out = []
    for name, build in (("rows", generate), ("runs", generate_runs)):
        build(*histories, run_ts=5.0).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def test_runs_hold_the_same_rows(both):
    rows, runs = both
    assert is_runs(runs) and not is_runs(rows)
    assert rows_of(expand(runs)) == rows_of(rows)
    assert runs.count() < rows.count() / 5


@pytest.mark.parametrize("cut", [3600.0, 7500.0, 200_000.0])
def test_runs_lose_what_lies_before_a_cut(both, cut):
    rows, runs = both
    assert rows_of(expand(later_than(runs, F.lit(cut)))) == rows_of(rows.where(F.col("start_ts") > cut))


def test_every_row_is_its_own_cells_once(both):
    rows, runs = both
    near = dealt(runs, 4)
    assert near.where("_own").count() == rows.count()
    assert near.count() > rows.count()


OPERATORS = {
    "counts": lambda g, h: generated_counts(g),
    "gaps": lambda g, h: quality.missing_rows(g),
    "resets": lambda g, h: quality.statistics_resets(g),
    "any_fall": lambda g, h: quality.statistics_resets(g, None),
    "preview": lambda g, h: preview(g, h[1], h[2]),
    "preview_of_all": lambda g, h: preview(g, h[1], h[2], 10_000, 10_000),
    "planned": lambda g, h: diff.planned_changes(h[1], g, h[2]),
    "condensed": lambda g, h: diff.planned_changes_condensed(h[1], g, h[2]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_give_the_same_on_runs(both, histories, name):
    rows, runs = (rows_of(OPERATORS[name](g, histories)) for g in both)
    assert runs == rows and rows


def test_condensing_at_once_is_condensing_afterwards(both, histories):
    before, after = diff.versions(histories[1], both[1], histories[1], histories[2])
    assert rows_of(diff.condensed_report(before, after)) == rows_of(diff.condense(diff.change_report(before, after)))


def test_a_stage_is_rebuilt_once(spark, tmp_path, states, statistics):
    readings = states(("sensor.old", 5000, "20"), ("sensor.new", 11_000, "30"), ("sensor.new", 14_600, "31"))
    stored = statistics([{"start_ts": 0, "sum": 100}, {"start_ts": 3600, "sum": 110}])
    classes = spark.createDataFrame([("sensor.old", "total"), ("sensor.new", "total")], "series_id string, state_class string")
    pair = spark.createDataFrame([("sensor.old", "sensor.new")], "old_id string, new_id string")
    run = lambda r, stage: splice.splice(pair, classes, r, stored, tables={"statistics": 3600}, run_ts=5.0, stage=stage)
    stage = f"{tmp_path}/stage"
    plain, first = run(readings, None), run(readings, stage)
    for name in plain:
        assert rows_of(first[name]) == rows_of(plain[name])
    # A finished stage is read, whatever the states are now; one without its mark is written again.
    assert rows_of(run(readings.limit(0), stage)["generated"]) == rows_of(plain["generated"])
    for part in ("eligibility", "generated"):
        Path(stage, part, "_SUCCESS").unlink()
    assert run(readings.limit(0), stage)["generated"].count() == 0
