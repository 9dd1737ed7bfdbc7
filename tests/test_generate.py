import pytest

from seriesweave.operators import quality
from seriesweave.operators.generate import generate, generated_counts, preview

HOURLY = {"statistics": 3600}
OLD = [{"start_ts": 0, "state": 10, "sum": 100, "created_ts": 123}, {"start_ts": 3600, "state": 20, "sum": 110, "created_ts": 124}]


def new(states, *rows):
    return states(*(("sensor.new", *r) for r in rows))


def sums(df):
    return {r.start_ts: r.sum for r in df.collect()}


def test_intervals_need_not_be_multiples(states, statistics, pairs):
    st = new(states, (10, "1"), (310, "5"), (460, "6"), (910, "9"), (1400, "9"))
    alone = {r.start_ts: (r.state, r.sum) for r in generate(st, statistics([]), pairs(), {"b": 450}, run_ts=1.0).collect()}
    both = generate(st, statistics([]), pairs(), {"a": 300, "b": 450}, run_ts=1.0).where("table = 'b'")
    assert {r.start_ts: (r.state, r.sum) for r in both.collect()} == alone and alone[0.0][0] == 5.0


def test_a_long_gap_is_expanded_in_spans(states, statistics, pairs):
    st = new(states, (0, "1"), (3600 * 1000, "2"), (3600 * 1001, "3"))
    got = sums(generate(st, statistics([]), pairs(), HOURLY, run_ts=1.0))
    assert sorted(got) == [3600.0 * i for i in range(1001)]


def test_empty_bucket_is_filled(states, statistics, pairs):
    st = new(states, (11000, "30"), (11100, "31"), (18100, "40"), (22000, "41"))
    rows = generate(st, statistics(OLD), pairs(), HOURLY, run_ts=9.0)
    assert sums(rows) == {0.0: 100.0, 3600.0: 110.0, 10800.0: 111.0, 14400.0: 111.0, 18000.0: 120.0}
    assert quality.statistics_resets(rows).collect() == []
    (gap,) = quality.missing_rows(rows).collect()
    assert (gap.series_id, gap.before_ts, gap.after_ts, gap.missing) == ("sensor.new", 3600.0, 10800.0, 1)
    assert (gap.before_state, gap.before_sum, gap.after_state, gap.after_sum) == (20.0, 110.0, 31.0, 111.0)
    created = {r.start_ts: r.created_ts for r in rows.collect()}
    assert created[0.0] == 123.0 and created[10800.0] == 9.0
    assert all(r.mean is None and r.last_reset_ts is None for r in rows.where("start_ts > 3600").collect())


@pytest.mark.parametrize("zero, expected", [(False, 110.0), (True, 140.0)])
def test_first_reading(states, statistics, pairs, zero, expected):
    st = new(states, (11000, "30"), (14600, "31"))
    assert sums(generate(st, statistics(OLD), pairs(zero=zero), HOURLY)) == {0.0: 100.0, 3600.0: 110.0, 10800.0: expected}


def test_falls_add_nothing(states, statistics, pairs):
    st = new(states, (11000, "30"), (11100, "29"), (11200, "1"), (11300, "4"), (14600, "0"))
    assert sums(generate(st, statistics(OLD), pairs(), HOURLY))[10800.0] == 113.0


def test_total(states, statistics, pairs):
    mark = '{"last_reset":"2025-01-0%dT00:00:00+00:00"}'
    st = new(states, (4000, "1", mark % 2), (4100, "2", mark % 2), (7300, "0.5", mark % 3), (7400, "0.75"), (11000, "7", mark % 4))
    old = [{"start_ts": 0, "state": 10, "sum": 100, "last_reset": "2025-01-01T00:00:00+00:00", "last_reset_ts": 1735689600}]
    rows = {r.start_ts: r for r in generate(st, statistics(old), pairs("total", True), HOURLY).collect()}
    assert (rows[0.0].last_reset, rows[0.0].last_reset_ts) == (None, 1735689600.0)
    assert (rows[3600.0].sum, rows[3600.0].last_reset, rows[3600.0].last_reset_ts) == (102.0, None, 1735776000.0)
    # 0.5 counts in full after the mark changed, 0.25 is an ordinary step; the
    # last row of the bucket has no mark, so that of the bucket before stays.
    assert (rows[7200.0].sum, rows[7200.0].last_reset_ts) == (102.75, 1735776000.0)
    assert set(rows) == {0.0, 3600.0, 7200.0}


def test_total_with_text_marks_only(states, statistics, pairs):
    st = new(states, (4000, "1", '{"last_reset":"2025-01-02T00:00:00+00:00"}'), (8000, "2"))
    old = [{"start_ts": 0, "sum": 100, "last_reset": "2025-01-01T00:00:00+00:00"}]
    rows = {r.start_ts: r for r in generate(st, statistics(old), pairs("total"), HOURLY, last_reset_as="text").collect()}
    assert (rows[0.0].last_reset, rows[0.0].last_reset_ts) == ("2025-01-01T00:00:00+00:00", 1735689600.0)
    assert (rows[3600.0].last_reset, rows[3600.0].last_reset_ts) == ("2025-01-02T00:00:00+00:00", None)


def test_measurement(states, statistics, pairs):
    old = [{"start_ts": 0, "state": 1, "min": 1, "mean": 1, "max": 1}, {"start_ts": 3600, "state": 2, "min": 2, "mean": 2, "max": 2}]
    st = new(states, (11000, "1"), (11100, "3"), (11200, "5"), (18100, "6"), (22000, "7"))
    rows = {r.start_ts: r for r in generate(st, statistics(old), pairs("measurement"), HOURLY).collect()}
    for start in (10800.0, 14400.0):
        r = rows[start]
        assert (r.state, r.min, r.mean, r.max, r.sum) == (5.0, 1.0, 3.0, 5.0, None)


def test_only_one_bucket(states, statistics, pairs):
    st = new(states, (11000, "30"), (11100, "33"))
    assert sums(generate(st, statistics(OLD), pairs(), HOURLY))[10800.0] == 113.0
    assert 10800.0 not in sums(generate(st, statistics(OLD), pairs(), HOURLY, strict_cutoff=True))


def test_texts_and_gaps_in_availability(states, statistics, pairs):
    st = new(states, (11000, "30kWh"), (11100, "unavailable"), (11200, "on"), (11300, "5"), (14600, None), (14700, "6"))
    # "on" counts as 0, so the 5 after it is a step of 5.
    assert sums(generate(st, statistics(OLD), pairs(), HOURLY))[10800.0] == 115.0


def test_rows_without_a_time_count_first(states, statistics, pairs):
    st = new(states, (None, "10"), (11000, "30"), (14600, "31"))
    assert sums(generate(st, statistics(OLD), pairs(zero=True), HOURLY))[10800.0] == 140.0


def test_both_tables_from_one_pass(states, statistics, pairs):
    st = new(states, (10900, "30"), (11300, "31"), (12000, "35"), (14600, "40"))
    short = statistics([{"start_ts": 300, "sum": 1000}], "statistics_short_term")
    rows = generate(st, statistics(OLD).unionByName(short), pairs()).collect()
    long = {r.start_ts: r.sum for r in rows if r.table == "statistics"}
    fine = {r.start_ts: r.sum for r in rows if r.table == "statistics_short_term"}
    assert long == {0.0: 100.0, 3600.0: 110.0, 10800.0: 115.0}
    assert fine[300.0] == 1000.0 and fine[10800.0] == 1000.0 and fine[11100.0] == 1001.0
    assert fine[11700.0] == 1001.0 and fine[12000.0] == 1005.0 and max(fine) == 14100.0
    assert len(fine) == 1 + (14100 - 10800) // 300 + 1


def test_no_usable_states_and_no_old_rows(states, statistics, pairs):
    assert sums(generate(new(states, (11000, "unknown")), statistics(OLD), pairs(), HOURLY)) == {0.0: 100.0, 3600.0: 110.0}
    st = new(states, (11000, "30"), (14600, "31"))
    assert sums(generate(st, statistics([]), pairs(zero=True), HOURLY)) == {10800.0: 30.0}


def test_overlap_keeps_both_rows(states, statistics, pairs):
    st = new(states, (3700, "30"), (8000, "31"))
    rows = generate(st, statistics(OLD), pairs(), HOURLY).where("start_ts = 3600").collect()
    assert sorted(r.state for r in rows) == [20.0, 30.0]


def test_preview(states, statistics, pairs):
    st = new(states, (11000, "30"), (11100, "31"), (14500, "32"))
    rows = generate(st, statistics(OLD), pairs(), HOURLY)
    shown = [r.start_ts for r in preview(rows, statistics(OLD), pairs()).orderBy("position").collect()]
    assert shown == [3600.0, 10800.0]

    st = new(states, *((11000 + 3600 * i, str(30 + i)) for i in range(8)))
    rows = generate(st, statistics(OLD), pairs(), HOURLY)
    shown = preview(rows, statistics(OLD), pairs()).orderBy("position").collect()
    assert [r.start_ts for r in shown] == [3600.0, 10800.0, 14400.0, 18000.0, None, 25200.0, 28800.0, 32400.0]
    assert [r.part for r in shown] == ["copied"] + ["generated"] * 3 + ["omitted"] + ["generated"] * 3
    assert shown[4].omitted == 1
    assert generated_counts(rows).first().row_count == 9


def test_preview_needs_old_rows(states, statistics, pairs):
    rows = generate(new(states, (11000, "30"), (14600, "31")), statistics([]), pairs(), HOURLY)
    assert preview(rows, statistics([]), pairs()).collect() == []


def test_sums_never_fall_and_have_no_inner_gaps(states, statistics, pairs):
    import random

    rng = random.Random(1)
    st = new(states, *((11000 + rng.randrange(10**6), str(rng.randrange(100))) for _ in range(200)))
    rows = generate(st, statistics(OLD), pairs(zero=True)).where("row_id is null")
    assert quality.missing_rows(rows).collect() == []
    totals = [r.sum for r in rows.where("table = 'statistics'").orderBy("start_ts").collect()]
    assert totals == sorted(totals)
