import pytest
from pyspark.sql import functions as F

from seriesweave.functions.text import gap_text, reset_text
from seriesweave.operators import quality


def events(df):
    return sorted(
        ((r.before_ts, r.before_value, r.after_ts, r.after_value, r.last_reset_ts) for r in df.collect()),
        key=lambda e: e[2],
    )


def test_state_fall(states):
    rows = states(("a", 100, "5"), ("a", 200, "6"), ("a", 300, "1"))
    assert events(quality.state_resets(rows)) == [(200.0, "6", 300.0, "1", None)]


def test_unavailable_and_texts_are_passed_over(states):
    rows = states(("a", 100, "5"), ("a", 150, "unavailable"), ("a", 160, "on"), ("a", 170, None), ("a", 300, "1"))
    assert events(quality.state_resets(rows)) == [(100.0, "5", 300.0, "1", None)]


def test_sum_only(statistics):
    rows = statistics([{"start_ts": 10, "sum": 10}, {"start_ts": 20, "sum": 11}, {"start_ts": 30, "sum": 2}])
    assert events(quality.statistics_resets(rows)) == [(20.0, "11.0", 30.0, "2.0", None)]


def test_reset_mark_is_shown(statistics):
    rows = statistics(
        [{"start_ts": 10, "sum": 10}, {"start_ts": 20, "sum": 11}, {"start_ts": 30, "sum": 2, "last_reset_ts": 25}]
    )
    assert events(quality.statistics_resets(rows)) == [(20.0, "11.0", 30.0, "2.0", 25.0)]


def test_state_wins_over_sum(statistics):
    rows = statistics([{"start_ts": 10 * i, "state": s, "sum": 100 + 10 * i} for i, s in enumerate((5, 6, 1))])
    assert len(events(quality.statistics_resets(rows))) == 1


def test_small_dip(states, statistics):
    assert events(quality.state_resets(states(("a", 1, "10"), ("a", 2, "9.5"), ("a", 3, "9.6")))) == []
    rows = statistics([{"start_ts": 0, "state": 10}, {"start_ts": 3600, "state": 9.5}])
    assert events(quality.statistics_resets(rows)) == []
    assert len(events(quality.statistics_resets(rows, None))) == 1


def test_state_marks(states):
    mark = '{"last_reset":"%s"}'
    rows = states(
        ("a", 5, "100"),
        ("a", 10, "105", mark % "2025-01-01T00:00:00+00:00"),
        ("a", 15, "108"),
        ("a", 20, "110", mark % "2025-01-01T01:00:00+01:00"),
        ("a", 30, "5", mark % "2025-02-01T00:00:00Z"),
        ("a", 40, "6", mark % "bogus"),
        ("a", 50, "7", "{broken"),
    )
    assert events(quality.state_resets(rows, "total")) == [(20.0, "110", 30.0, "5", 1738368000.0)]


@pytest.mark.parametrize("as_text", [False, True])
def test_statistics_marks(statistics, as_text):
    marks = ("2025-01-01T00:00:00+00:00", "2025-02-01T00:00:00+00:00") if as_text else (1000, 2000)
    name = "last_reset" if as_text else "last_reset_ts"
    rows = statistics(
        [
            {"start_ts": 10, "state": 100},
            {"start_ts": 20, "state": 110, name: marks[0]},
            {"start_ts": 25, "state": 111},
            {"start_ts": 30, "state": 5, name: marks[1]},
        ]
    )
    found = events(quality.statistics_resets(rows, "total", "text" if as_text else "epoch"))
    assert found == [(25.0, "111.0", 30.0, "5.0", 1738368000.0 if as_text else 2000.0)]


def test_mode_per_series(states):
    rows = states(("a", 1, "10"), ("a", 2, "1"), ("b", 1, "10"), ("b", 2, "1"))
    mode = F.when(F.col("series_id") == "a", "total_increasing").otherwise("total")
    assert [r.series_id for r in quality.state_resets(rows.withColumn("m", mode), F.col("m")).collect()] == ["a"]


def test_regular_rows_have_no_gaps(statistics):
    rows = statistics([{"start_ts": t} for t in (2000, 5600, 9200)]).unionByName(
        statistics([{"start_ts": t} for t in (1000, 1300, 1600)], "statistics_short_term")
    )
    assert quality.missing_rows(rows).collect() == []


def test_gaps(statistics):
    rows = statistics(
        [{"start_ts": 2000, "state": 1, "sum": 10}, {"start_ts": 9200, "state": 3, "sum": 30}]
    ).unionByName(
        statistics([{"start_ts": 1000, "state": 5, "sum": 50}, {"start_ts": 1600, "state": 7, "sum": 70}], "statistics_short_term")
    )
    found = {r.table: r for r in quality.missing_rows(rows).collect()}
    assert {t: r.missing for t, r in found.items()} == {"statistics": 1, "statistics_short_term": 1}
    texts = [r[0] for r in quality.missing_rows(rows).select(gap_text()).collect()]
    assert "1970-01-01 00:33:20 - 1970-01-01 02:33:20 [1 rows]\n1.0/10.0 - 3.0/30.0" in texts


def test_rows_without_a_time_make_no_gap(statistics):
    rows = statistics([{"start_ts": None}, {"start_ts": 36000}])
    assert quality.missing_rows(rows).collect() == []


def test_report_joins_states_with_each_table(spark, states, statistics):
    st = states(("a", 100, "5"), ("a", 300, "1"), ("m", 100, "5"), ("m", 300, "1"))
    stats = statistics([{"series_id": "a", "start_ts": 0, "sum": 5}, {"series_id": "a", "start_ts": 3600, "sum": 1}])
    classes = spark.createDataFrame([("a", "total_increasing"), ("m", "measurement")], "series_id string, state_class string")
    report = quality.reset_report(st, stats, classes)
    rows = sorted((r.report, r.table, r.series_id) for r in report.collect())
    assert rows == [
        ("statistics", "states", "a"),
        ("statistics", "statistics", "a"),
        ("statistics_short_term", "states", "a"),
    ]
    text = report.where("table = 'states'").select(reset_text()).first()[0]
    assert text == "1970-01-01 00:01:40 - 1970-01-01 00:05:00\n5 - 1"
