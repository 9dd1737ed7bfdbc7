import itertools
import random

import pytest
from pyspark.sql import functions as F

from seriesweave.operators import attributes, profile
from seriesweave.plans.segments import segments
from seriesweave.plans.timeline import Chunking


def by_table(df):
    return {r["table"]: r for r in df.collect()}


def test_state_summary_and_runs(states):
    rows = states(("sensor.a", 100, "1"), ("sensor.a", 200, ""), ("sensor.a", 300, None))
    (s,) = profile.summarize_states(rows).collect()
    assert (s.row_count, s.unavailable_count) == (3, 2)
    assert (s.earliest.value, s.latest.ts, s.latest.value) == ("1", 300.0, None)
    assert s.earliest_available.value == s.latest_available.value == "1"
    runs = sorted((r.start_ts, r.end_ts, r.row_count, r.value) for r in profile.state_outages(rows).collect())
    assert runs == [(200.0, 200.0, 1, ""), (300.0, 300.0, 1, "NULL")]


def test_runs_join_rows_with_one_text_only(states):
    texts = ["unavailable", "unavailable", "unknown", "5", "unknown", None, None]
    rows = states(*(("sensor.a", i, t) for i, t in enumerate(texts)))
    runs = sorted((r.start_ts, r.end_ts, r.row_count, r.value) for r in profile.state_outages(rows).collect())
    assert runs == [(0.0, 1.0, 2, "unavailable"), (2.0, 2.0, 1, "unknown"), (4.0, 4.0, 1, "unknown"), (5.0, 6.0, 2, "NULL")]


def test_details_only_up_to_the_limit(states):
    rows = states(*(("sensor.many", i, None) for i in range(4)), ("sensor.few", 1, ""), ("sensor.none", 1, "1"))
    assert [r.series_id for r in profile.state_outages(rows, max_rows=3).collect()] == ["sensor.few"]
    assert {r.series_id for r in profile.state_outages(rows, max_rows=4).collect()} == {"sensor.few", "sensor.many"}


def test_statistics_runs_are_not_split_by_value(statistics):
    rows = statistics([{"start_ts": 0}, {"start_ts": 3600}, {"start_ts": 7200, "sum": 1}, {"start_ts": 10800}])
    runs = sorted((r.start_ts, r.end_ts, r.row_count, r.value) for r in profile.statistics_outages(rows).collect())
    assert runs == [(0.0, 3600.0, 2, "NULL"), (10800.0, 10800.0, 1, "NULL")]


def test_statistics_summary_values(statistics):
    rows = statistics(
        [
            {"start_ts": 1000, "mean": 1.5, "sum": 10, "series_id": "sensor.a"},
            {"start_ts": 2000, "mean": 2.5, "sum": 20, "last_reset_ts": 1500, "series_id": "sensor.a"},
        ]
    ).unionByName(statistics([{"start_ts": 3000, "mean": 3.5, "series_id": "sensor.a"}], "statistics_short_term"))
    s = by_table(profile.summarize_statistics(rows))
    long = s["statistics"]
    assert (long.earliest.value, long.earliest.sum, long.latest.value, long.latest.sum) == (1.5, 10.0, 2.5, 20.0)
    assert s["statistics_short_term"].row_count == 1
    (mark,) = profile.last_reset_rows(rows).collect()
    assert (mark.table, mark.start_ts, mark.last_reset_ts) == ("statistics", 2000.0, 1500.0)


def test_merged_summary(states, statistics):
    stats = statistics([{"start_ts": 1000, "mean": 1.5, "sum": 10, "series_id": "sensor.a"}])
    merged = by_table(
        profile.summarize_all(
            states(("sensor.a", 100, "1"), ("sensor.a", 200, "unavailable")), stats, F.lit(True)
        )
    )
    assert merged["states"].latest.value == "unavailable"
    assert merged["states"].latest_available.value == "1"
    assert merged["states"].earliest_available is None
    paths = {
        r.path: r.value
        for r in profile.summary_paths(profile.summarize_all(states(), stats, F.lit(True))).collect()
    }
    assert paths["statistics/earliest/value"] == "1.5 (10.0)"
    assert paths["statistics/row_count"] == "1"
    assert "statistics/earliest_available/ts" not in paths
    plain = profile.summary_paths(profile.summarize_all(states(), stats)).where("path = 'statistics/latest/value'")
    assert plain.first().value == "1.5"


def test_nothing_available_is_shown_as_null(states, statistics):
    paths = {
        r.path: r.value
        for r in profile.summary_paths(profile.summarize_all(states(("s", 1, "unknown")), statistics([]))).collect()
    }
    assert paths["states/earliest_available/value"] is None
    assert paths["states/earliest/value"] == "unknown"


def test_ends(states, statistics):
    assert profile.earliest_state(states(("a", 5, "1"), ("a", 3, None))).first().ts == 3.0
    assert profile.latest_statistics(statistics([{"start_ts": 0}, {"start_ts": 3600}])).first().ts == 3600.0


def test_rows_without_a_time_come_first(states):
    (s,) = profile.summarize_states(states(("a", None, "9"), ("a", 3, "1"))).collect()
    assert (s.earliest.ts, s.earliest.value, s.latest.value) == (None, "9", "1")


def test_summary_comparison_counts_absent_series_as_empty(spark, states, statistics):
    pairs = spark.createDataFrame([("sensor.old", "sensor.new")], "old_id string, new_id string")
    summary = profile.summarize_all(states(("sensor.old", 100, "1")), statistics([]))
    rows = {r.path: r for r in attributes.compare_summaries(summary, pairs, ("states",)).collect()}
    assert (rows["states/row_count"].old_value, rows["states/row_count"].new_value) == ("1", "0")
    assert (rows["states/earliest/value"].new_value, rows["states/earliest/value"].diff) == ("null", "different")
    assert rows["states/unavailable_count"].diff == "same"


@pytest.mark.parametrize("span", [10, 97, 86_400])
def test_segments_do_not_depend_on_cells(spark, span):
    """Against itertools.groupby, with rows without a time and stretches over many cells."""
    rng = random.Random(span)
    rows = []
    for series in "abc":
        value = "x"
        for i in range(300):
            value = rng.choice("xyz") if rng.random() < 0.2 else value
            rows.append((series, None if i < 5 else float(i * 3), i, None if value == "z" else value))
    frame = spark.createDataFrame(rows, "series_id string, ts double, row_id long, v string")
    got = segments(frame, ["series_id"], ["ts", "row_id"], ["v"], Chunking(span)).collect()
    expected = []
    for (series, value), run in itertools.groupby(rows, key=lambda r: (r[0], r[3])):
        times = [r[1] for r in run]
        known = [t for t in times if t is not None]
        expected.append((series, value, min(known, default=None), max(known, default=None), len(times)))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
