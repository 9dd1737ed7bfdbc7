from pyspark.sql import functions as F

from seriesweave.operators import diff
from seriesweave.operators.generate import generate

BEFORE = [{"start_ts": 0, "state": 1, "sum": 10, "created_ts": 1}, {"start_ts": 3600, "state": 2, "sum": 20, "created_ts": 2}]
AFTER = [{"start_ts": 0, "state": 1.5, "sum": 10, "created_ts": 3}, {"start_ts": 7200, "state": 3, "sum": 30, "created_ts": 4}]


def test_change_report(statistics):
    report = diff.change_report(statistics(BEFORE), statistics(AFTER))
    assert report.count() == 3
    assert diff.changed_columns(report).first().columns == ["created_ts", "state", "sum"]
    cells = {r.start_ts: r for r in diff.change_cells(report).collect()}
    assert (cells[0.0].state, cells[0.0].sum) == ("1.0 -> 1.5 (+0.5)", "")
    assert (cells[3600.0].state, cells[3600.0].sum) == ("2.0 -> (none)", "20.0 -> (none)")
    assert (cells[7200.0].state, cells[7200.0].sum) == ("(none) -> 3.0", "(none) -> 30.0")
    assert cells[0.0].created_ts == "1970-01-01 00:00:01 -> 1970-01-01 00:00:03"
    assert cells[0.0].start == "1970-01-01 00:00:00"


def test_times_compare_by_the_second_and_nan_equals_itself(statistics):
    a = statistics([{"start_ts": 0, "state": float("nan"), "created_ts": 1.2}])
    b = statistics([{"start_ts": 0, "state": float("nan"), "created_ts": 1.9}])
    assert diff.change_report(a, b).collect() == []


def test_later_copy_of_a_start_counts(statistics):
    a = statistics([{"start_ts": 0, "state": 1}, {"start_ts": 0, "state": 2}])
    (row,) = diff.change_report(a, statistics([{"start_ts": 0, "state": 5}])).collect()
    assert (row.state.old, row.state.new, row.state.delta) == (2.0, 5.0, 3.0)


def test_a_table_does_not_differ_from_itself(statistics):
    assert diff.change_report(statistics(BEFORE), statistics(BEFORE)).collect() == []


def condensed(statistics, starts, special=()):
    before = statistics([{"start_ts": t, "state": 1, "sum": 1} for t in starts])
    after = before.withColumns(
        {"sum": F.lit(2.0), "created_ts": F.lit(5.0), "state": F.when(F.col("start_ts").isin(*special or [-1.0]), 9.0).otherwise(F.col("state"))}
    )
    rows = diff.condense(diff.change_report(before, after)).orderBy("start_ts").collect()
    return [(r.start_ts, r.omitted_before) for r in rows]


def test_condense_keeps_ends_and_rows_that_matter(statistics):
    starts = [3600 * i for i in range(10)]
    assert condensed(statistics, starts, [5 * 3600.0]) == [
        (0.0, False), (3600.0, False), (7200.0, False), (18000.0, True), (25200.0, True), (28800.0, False), (32400.0, False)
    ]


def test_condense_short_and_broken_blocks(statistics):
    assert len(condensed(statistics, [3600 * i for i in range(6)])) == 6
    broken = [3600 * i for i in range(7)] + [3600 * i for i in range(9, 16)]
    kept = condensed(statistics, broken)
    assert [t / 3600 for t, _ in kept] == [0, 1, 2, 4, 5, 6, 9, 10, 11, 13, 14, 15]
    assert [t / 3600 for t, o in kept if o] == [4, 13]


def test_condense_across_chunk_borders(statistics):
    for shift in (281, 284, 287, 288):
        starts = [3600 * (shift + i) for i in range(12)]
        kept = condensed(statistics, starts, [3600.0 * (shift + 6)])
        assert [t / 3600 - shift for t, _ in kept] == [0, 1, 2, 6, 9, 10, 11], shift
        assert [t / 3600 - shift for t, o in kept if o] == [6, 9], shift


def test_planned_changes_only_after_the_old_series(states, statistics, pairs):
    stored = statistics(
        [
            {"start_ts": 0, "state": 10, "sum": 100},
            {"start_ts": 3600, "state": 20, "sum": 110},
            {"series_id": "sensor.new", "start_ts": 0, "sum": 999},
            {"series_id": "sensor.new", "start_ts": 7200, "sum": 999},
        ]
    )
    st = states(("sensor.new", 11000, "30"), ("sensor.new", 14600, "31"))
    generated = generate(st, stored, pairs(), {"statistics": 3600})
    rows = {r.start_ts: r for r in diff.planned_changes(stored, generated, pairs()).collect()}
    assert set(rows) == {7200.0, 10800.0}
    assert (rows[7200.0].sum.old, rows[7200.0].sum.new) == (999.0, None)
    assert (rows[10800.0].sum.old, rows[10800.0].sum.new) == (None, 110.0)


def test_snapshot_without_a_cut_keeps_all_dated_rows(statistics):
    rows = statistics([{"start_ts": None}, {"start_ts": 0, "state": 1}, {"start_ts": 0, "state": 2}])
    assert [r.state for r in diff.snapshot(rows).collect()] == [2.0]
    assert diff.snapshot(rows).columns == rows.columns
    assert diff.snapshot(rows, fold=False).count() == 2


def test_only_unequal_cells_meet(spark, statistics):
    day = 288 * 3600
    rows = [{"start_ts": t, "state": t % 7, "sum": t} for t in range(0, 4 * day, 3600)]
    before = statistics(rows + [{"start_ts": 5 * day, "state": 1}, {"start_ts": 5 * day, "state": None, "mean": 1}])
    assert diff.unequal_cells(before, before.orderBy(F.desc("start_ts"))).count() == 0
    assert diff.change_report_by_cells(before, before).count() == 0
    at = F.col("start_ts")
    after = before.withColumn("sum", F.when(at == 3600.0, 5.0).otherwise(F.col("sum"))).where(at != day + 7200.0)
    # A NULL in one column is not a NULL in another one.
    after = after.withColumns({c: F.when(at == 5 * day, F.col(o)).otherwise(F.col(c)) for c, o in (("state", "mean"), ("mean", "state"))})
    assert sorted(r.cell for r in diff.unequal_cells(before, after).collect()) == [0, 1, 5]
    whole, cells = diff.change_report(before, after), diff.change_report_by_cells(before, after)
    assert sorted(map(str, cells.collect())) == sorted(map(str, whole.collect())) and whole.count() == 3
    # Repeated rows count as often as they occur.
    assert [r.cell for r in diff.unequal_cells(before, before.unionByName(before.where(at == 0.0))).collect()] == [0]
