import pytest

from seriesweave.operators import splice
from seriesweave.operators.generate import generate
from seriesweave.sources import sinks

HOURLY = {"statistics": 3600}
STORED = [
    {"start_ts": 0, "state": 10, "sum": 100},
    {"start_ts": 3600, "state": 20, "sum": 110},
    {"series_id": "sensor.new", "start_ts": 0, "state": 999, "sum": 999},
    {"series_id": "sensor.other", "start_ts": 0, "state": 1, "sum": 1},
]


@pytest.fixture(scope="module")
def classes(spark):
    def make(old="total_increasing", new="total_increasing"):
        return spark.createDataFrame([("sensor.old", old), ("sensor.new", new)], "series_id string, state_class string")

    return make


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([("sensor.old", "sensor.new")], "old_id string, new_id string")


def usual(states):
    return states(("sensor.old", 5000, "20"), ("sensor.new", 11000, "30"), ("sensor.new", 14600, "31"))


def reason(pair, classes, states, statistics=None):
    row = splice.eligibility(pair, classes, states, statistics).first()
    assert row.eligible == (row.reason is None)
    return row.reason


def test_eligibility(pair, classes, states, statistics):
    good = usual(states)
    assert reason(pair, classes(), good) is None
    assert reason(pair, classes(new="total"), good) == "classes differ or are not supported"
    assert reason(pair, classes("other", "other"), good) == "classes differ or are not supported"
    assert reason(pair, classes(None, None), good) == "classes differ or are not supported"
    assert reason(pair, classes(), states(("sensor.new", 1, "1"))) == "no available states"
    assert reason(pair, classes(), states(("sensor.old", 9, "1"), ("sensor.new", 10, "unknown"))) == "no available states"
    late = "new states start before old states end"
    assert reason(pair, classes(), states(("sensor.old", 10.2, "1"), ("sensor.new", 10.9, "1"))) == late
    assert reason(pair, classes(), states(("sensor.old", 10.9, "1"), ("sensor.new", 11, "1"))) is None
    row = splice.eligibility(pair, classes(), good, statistics([{"start_ts": 14400}])).first()
    assert row.eligible and row.overlaps_statistics


def test_replace_series(states, statistics, pairs):
    stored = statistics(STORED)
    generated = generate(usual(states), stored, pairs(), HOURLY)
    rows = sinks.replace_series(stored, generated, pairs()).collect()
    assert sorted((r.start_ts, r.state, r.sum) for r in rows if r.series_id == "sensor.new") == [
        (0.0, 10.0, 100.0), (3600.0, 20.0, 110.0), (10800.0, 30.0, 110.0)
    ]
    assert len(rows) == 6


def test_other_tables_stay_as_they_are(states, statistics, pairs):
    short = statistics([{"series_id": "sensor.new", "start_ts": 0, "sum": 7}], "statistics_short_term")
    stored = statistics(STORED).unionByName(short)
    generated = generate(usual(states), stored, pairs(), HOURLY)
    kept = sinks.replace_series(stored, generated, pairs(), list(HOURLY)).where("table = 'statistics_short_term'")
    assert [r.sum for r in kept.collect()] == [7.0]
    assert sinks.replace_series(stored, generated, pairs()).where("table = 'statistics_short_term'").count() == 0


def test_whole_job(pair, classes, states, statistics):
    parts = splice.splice(pair, classes(), usual(states), statistics(STORED), tables=HOURLY, started_from_0=True, run_ts=5.0)
    assert parts["counts"].first().row_count == 3
    assert parts["gaps"].count() == 1 and parts["resets"].count() == 0
    assert [r.start_ts for r in parts["preview"].orderBy("position").collect()] == [3600.0, 10800.0]
    (change,) = parts["changes"].collect()
    assert (change.start_ts, change.sum.new) == (10800.0, 140.0)
    assert parts["condensed"].count() == 1
    after = parts["result"]
    replaced = splice.applied_changes(statistics(STORED), after, statistics(STORED), parts["eligibility"])
    assert [r.start_ts for r in replaced.collect()] == [10800.0]


def test_ineligible_pairs_change_nothing(pair, classes, states, statistics):
    parts = splice.splice(pair, classes(new="total"), usual(states), statistics(STORED), tables=HOURLY)
    assert parts["generated"].count() == 0
    assert parts["result"].count() == 4


def test_target_rows(spark, statistics):
    rows = statistics([{"series_id": "sensor.new", "start_ts": 3600, "sum": 5, "created_ts": 1}, {"series_id": "sensor.new", "start_ts": 7200.5, "sum": 6}])
    meta = spark.createDataFrame([(2, "sensor.new")], "id long, statistic_id string")
    target = spark.createDataFrame([], "metadata_id long, created_ts double, start_ts double, sum double")
    got = sorted(sinks.as_target_rows(rows, target, meta, 9.0).collect())
    assert [tuple(r) for r in got] == [(2, 1.0, 3600.0, 5.0), (2, 9.0, 7200.5, 6.0)]
    legacy = spark.createDataFrame([], "statistic_id string, start string, mean double")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = sinks.as_target_rows(rows, legacy).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(r.start for r in got) == ["1970-01-01 01:00:00", "1970-01-01 02:00:00"]
    with pytest.raises(ValueError):
        sinks.as_target_rows(rows, target)


def test_rows_of_unknown_ids_are_not_lost(spark, statistics):
    target = spark.createDataFrame([], "metadata_id long, start_ts double, sum double")
    meta = spark.createDataFrame([(1, "sensor.old")], "id long, statistic_id string")
    rows = statistics([{"series_id": "sensor.new", "start_ts": 0, "sum": 1}])
    with pytest.raises(Exception, match="no target id: sensor.new"):
        sinks.as_target_rows(rows, target, meta).collect()


def test_marks_are_written_as_text_where_the_table_has_only_that(spark, statistics):
    target = spark.createDataFrame([], "statistic_id string, start_ts double, last_reset string")
    rows = statistics([{"start_ts": 0, "last_reset_ts": 86400.0}])
    assert sinks.as_target_rows(rows, target).first().last_reset == "1970-01-02T00:00:00+00:00"


def test_pairs_without_a_target_id(spark, pairs):
    meta = spark.createDataFrame([(1, "sensor.old")], "id long, statistic_id string")
    assert sinks.without_target_id(pairs(), meta).first().reason == "no target id"


def test_write_and_swap_in_place(spark, tmp_path, states, statistics, pairs):
    path = f"{tmp_path}/statistics"
    short = statistics([{"series_id": "sensor.new", "start_ts": 0, "sum": 7}], "statistics_short_term")
    sinks.write_bucketed(statistics(STORED).unionByName(short), path, 4)
    stored = spark.read.parquet(path).drop(sinks.BUCKET)
    # All that lies in the replaced layout is read before anything is written there.
    generated = generate(usual(states), stored, pairs(), HOURLY)
    sinks.swap_in_place(path, generated, pairs(), 4, f"{tmp_path}/staging")
    spark.catalog.refreshByPath(path)
    rows = spark.read.parquet(path).collect()
    assert sorted((r.start_ts, r.sum) for r in rows if r.series_id == "sensor.new") == [(0.0, 100.0), (3600.0, 110.0), (10800.0, 110.0)]
    assert {r.series_id for r in rows} == {"sensor.old", "sensor.new", "sensor.other"}

    version = f"{tmp_path}/v2"
    sinks.write_version(statistics(STORED), version)
    assert spark.read.parquet(version).count() == 4
    with pytest.raises(Exception):
        sinks.write_version(statistics(STORED), version)
