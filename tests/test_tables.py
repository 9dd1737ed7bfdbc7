import pytest

from seriesweave.operators import profile, quality
from seriesweave.schema import STATES, STATISTICS
from seriesweave.sources.sinks import BUCKET, with_bucket, write_bucketed
from seriesweave.sources.tables import TableError, canonical_states, canonical_statistics, jdbc_options, only_series


def test_states_by_dictionary(spark):
    states = spark.createDataFrame([(1, "a", 10.0), (1, "b", 20.0), (2, "c", 5.0)], "metadata_id long, state string, last_updated_ts double")
    meta = spark.createDataFrame([(1, "sensor.a")], "metadata_id long, entity_id string")
    rows = canonical_states(states, meta).orderBy("ts").collect()
    assert [(r.series_id, r.ts, r.state) for r in rows] == [("sensor.a", 10.0, "a"), ("sensor.a", 20.0, "b")]
    assert canonical_states(states, meta).columns == STATES.fieldNames()


def test_states_time_columns_by_preference(spark):
    both = spark.createDataFrame([("s", "1", 5.0, "2025-01-01 00:00:00")], "entity_id string, state string, last_changed_ts double, last_updated string")
    assert canonical_states(both).first().ts == 5.0
    text = both.select("entity_id", "state", "last_updated")
    assert canonical_states(text).first().ts == 1735689600.0
    assert canonical_states(text, text_zone="utc").first().ts == 1735689600.0


def test_unusable_tables(spark):
    odd = spark.createDataFrame([("1",)], "state string")
    assert canonical_states(odd).collect() == [] and canonical_statistics(odd).collect() == []
    with pytest.raises(TableError):
        canonical_states(odd, strict=True)
    with pytest.raises(TableError):
        canonical_statistics(odd, strict=True)


@pytest.fixture(scope="module")
def with_attributes(spark):
    states = spark.createDataFrame(
        [("s", "1", 1.0, 10, '{"i":1}'), ("s", "2", 2.0, None, '{"i":2}'), ("s", "3", 3.0, 11, None)],
        "entity_id string, state string, last_updated_ts double, attributes_id long, attributes string",
    )
    shared = spark.createDataFrame([(10, '{"s":1}'), (11, '{"s":3}')], "attributes_id long, shared_attrs string")
    return states, shared


def payloads(df):
    return {r.ts: (r.attrs, r.attrs_fallback) for r in df.collect()}


def test_attributes_for_a_rebuild(with_attributes):
    states, shared = with_attributes
    assert payloads(canonical_states(states, state_attributes=shared)) == {
        1.0: ('{"s":1}', '{"i":1}'), 2.0: (None, '{"i":2}'), 3.0: ('{"s":3}', None)
    }
    assert payloads(canonical_states(states))[2.0] == ('{"i":2}', None)


def test_attributes_for_detection(with_attributes):
    states, shared = with_attributes
    assert payloads(canonical_states(states, state_attributes=shared, attributes="detect")) == {
        1.0: ('{"s":1}', None), 3.0: ('{"s":3}', None)
    }
    older = shared.toDF("id", "attributes")
    assert set(payloads(canonical_states(states, state_attributes=older, attributes="detect"))) == {1.0, 3.0}
    assert payloads(canonical_states(states, attributes="detect"))[1.0] == ('{"i":1}', None)


def test_attributes_for_a_probe(with_attributes):
    states, shared = with_attributes
    got = payloads(canonical_states(states, state_attributes=shared, attributes="probe"))
    assert {t: a for t, (a, _) in got.items()} == {1.0: '{"i":1}', 2.0: '{"i":2}', 3.0: '{"s":3}'}


def test_statistics_layouts(spark):
    rows = spark.createDataFrame([(7, 1000.0, 10.0)], "metadata_id long, start_ts double, sum double")
    meta = spark.createDataFrame([(7, "sensor.a")], "id long, statistic_id string")
    (r,) = canonical_statistics(rows, meta, table="statistics_short_term").collect()
    assert (r.series_id, r.table, r.interval_s, r.start_ts, r.state, r.sum) == ("sensor.a", "statistics_short_term", 300, 1000.0, None, 10.0)
    text = spark.createDataFrame([("s", "2025-01-01T00:00:00Z", "5")], "statistic_id string, start string, state string")
    (r,) = canonical_statistics(text).collect()
    assert (r.start_ts, r.state) == (1735689600.0, 5.0)
    assert canonical_statistics(text).columns == STATISTICS.fieldNames()


def test_only_series(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "series_id string")
    assert [r[0] for r in only_series(rows, spark.createDataFrame([("b",)], "series_id string")).collect()] == ["b"]


def test_jdbc_reads_are_split_by_key():
    options = jdbc_options("jdbc:x", "states", "state_id", 1, 10**9, 400, fetchsize="10000")
    assert options["partitionColumn"] == "state_id" and options["numPartitions"] == "400"
    assert options["dbtable"] == "states" and options["fetchsize"] == "10000"


def test_reset_marks_go_by_the_layout_of_their_table(spark):
    """A table with epochs may still hold texts from before; they are not its marks."""
    newer = spark.createDataFrame(
        [(1, "sensor.a", 0.0, 1.0, "2024-01-01T00:00:00+00:00", None), (2, "sensor.a", 3600.0, 2.0, None, 10.0), (3, "sensor.a", 7200.0, 3.0, None, 20.0)],
        "id long, statistic_id string, start_ts double, state double, last_reset string, last_reset_ts double",
    )
    older = spark.createDataFrame(
        [(1, "sensor.b", 0.0, 1.0, "2024-01-01T00:00:00+00:00"), (2, "sensor.b", 3600.0, 2.0, "2024-01-02T00:00:00+00:00"), (3, "sensor.b", 7200.0, 3.0, None)],
        "id long, statistic_id string, start_ts double, state double, last_reset string",
    )
    both = canonical_statistics(newer, layout=True).unionByName(canonical_statistics(older, layout=True))
    found = {(r.series_id, r.start_ts): (r.last_reset_ts, r.last_reset) for r in profile.last_reset_rows(both).collect()}
    assert found == {
        ("sensor.a", 3600.0): (10.0, None), ("sensor.a", 7200.0): (20.0, None),
        ("sensor.b", 0.0): (None, "2024-01-01T00:00:00+00:00"), ("sensor.b", 3600.0): (None, "2024-01-02T00:00:00+00:00"),
    }
    resets = {(r.series_id, r.event_ts, r.last_reset_ts) for r in quality.statistics_resets(both, "total").collect()}
    assert resets == {("sensor.a", 7200.0, 20.0), ("sensor.b", 3600.0, 1704153600.0)}
    # Without the layout the caller tells, as before.
    plain = canonical_statistics(older)
    assert profile.last_reset_rows(plain).count() == 0 and profile.last_reset_rows(plain, "text").count() == 2


def _files_read(df):
    """Files that the scan of a frame opened, once it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    scans = [s.plan() if hasattr(s, "plan") and "Stage" in s.nodeName() else s for s in scans]
    return sum(s.metrics().apply("numFiles").value() for s in scans if s.nodeName().startswith("Scan parquet"))


@pytest.mark.parametrize("kind", ["states", "statistics"])
def test_a_few_series_are_found_in_their_buckets_only(spark, tmp_path, states, statistics, kind):
    if kind == "states":
        rows = states(*((f"sensor.s{i}", 10 * i, "1") for i in range(200)))
    else:
        rows = statistics([{"series_id": f"sensor.s{i}", "start_ts": 3600} for i in range(200)])
    write_bucketed(rows, f"{tmp_path}/t", 32)
    stored = spark.read.parquet(f"{tmp_path}/t")
    wanted = spark.createDataFrame([("sensor.s7",), ("sensor.s11",), ("sensor.none",)], "series_id string")
    found = only_series(stored, wanted, buckets=32)
    assert sorted(r.series_id for r in found.collect()) == ["sensor.s11", "sensor.s7"]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert f"dynamicpruningexpression({BUCKET}" in text
    buckets = with_bucket(wanted, 32).select(BUCKET).distinct().count()
    files, every = _files_read(found), _files_read(stored)
    assert files <= buckets < every
