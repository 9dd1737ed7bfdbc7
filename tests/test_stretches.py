"""Comparing runs without expanding them first gives what comparing their rows gives."""

import random

import pytest

from seriesweave.operators import diff
from seriesweave.plans.runs import dealt, expand, from_stretches, stretches
from seriesweave.schema import STATISTICS
from seriesweave.sources.sinks import replace_series


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def _made(spark, rows, runs):
    names = STATISTICS.fieldNames() + (["until_ts"] if runs else [])
    data = [tuple(r.get(n) for n in names) for r in rows]
    schema = STATISTICS.simpleString()[7:-1].replace(":", " ") + (",until_ts double" if runs else "")
    return spark.createDataFrame(data, schema)


def _runs(rng, shift=0.0, meet=False, trivial=False):
    rows, at = [], 1000
    for i in range(25):
        n = rng.choice([1, 1, 2, 9, 17, 18, 40, 700])
        row = {"series_id": "s", "table": "t", "interval_s": 300, "start_ts": at * 300 + shift, "state": 1.0 if trivial else float(rng.randint(0, 2)), "sum": float(i)}
        rows.append(row | {"until_ts": row["start_ts"] + n * 300})
        if meet and rng.random() < 0.2:
            rows.append(rows[-1] | {"row_id": i, "state": 9.0, "until_ts": row["start_ts"] + rng.choice([1, n + 3]) * 300})
        at += n + rng.choice([0, 0, 1, 5, 400])
    return rows


def _rows(rng, shift=0.0, trivial=False):
    starts = [rng.randint(900, 5000) * 300 + rng.choice([0.0, 0.0, 0.0, 120.0]) + shift for _ in range(300)]
    return [
        {"series_id": rng.choice("ss" if trivial else "ssu"), "table": "t", "interval_s": 300, "row_id": i, "start_ts": t, "state": 1.0 if trivial else float(rng.randint(0, 2)), "sum": 1.0}
        for i, t in enumerate(starts + starts[:30])
    ]


CASES = {
    "rows": lambda rng: ((_rows(rng), False), (_runs(rng), True)),
    "fractions": lambda rng: ((_rows(rng, 0.1), False), (_runs(rng, 0.1), True)),
    "runs_that_meet": lambda rng: ((_rows(rng), False), (_runs(rng, meet=True), True)),
    "two_sides_of_runs": lambda rng: ((_runs(rng), True), (_runs(rng), True)),
    "other_grid": lambda rng: ((_runs(rng, 150.0), True), (_runs(rng), True)),
}


@pytest.mark.parametrize("name", CASES)
def test_changes_of_runs(spark, name):
    rng = random.Random(1)
    before, after = (_made(spark, rows, runs) for rows, runs in CASES[name](rng))
    plain = [expand(df) for df in (before, after)]
    assert rows_of(diff.change_report(before, after)) == rows_of(diff.change_report(*plain))
    assert rows_of(diff.condensed_report(before, after)) == rows_of(diff.condensed_report(*plain))


def test_unimportant_changes_of_long_runs_are_condensed(spark):
    """Both versions are one another's runs but for their sums, so the middle of every block goes."""
    rows = _runs(random.Random(3), trivial=True)
    before, after = _made(spark, rows, True), _made(spark, [r | {"sum": -1.0} for r in rows], True)
    ones = expand(before)
    found = rows_of(diff.condensed_report(ones, after))
    assert found == rows_of(diff.condensed_report(ones, expand(after)))
    whole = rows_of(diff.condensed_report(before, _made(spark, [], False)))
    assert whole == rows_of(diff.condensed_report(ones, _made(spark, [], False)))
    assert len(found) < ones.count() / 3
    # Only rows that stay are made, and only the ends of a stretch meet in the windows.
    of = lambda df: diff._ends_apart(diff._compared(before.limit(0), df, diff.COMPARED, 4)).count()
    assert of(after) < expand(after).count() / 2


def test_stretches_stand_for_the_dealt_rows(spark):
    rng = random.Random(4)
    for reach in (0, 4):
        runs = _made(spark, _runs(rng), True)
        cut = stretches(runs, reach)
        assert rows_of(from_stretches(cut)) == rows_of(dealt(runs, reach))
        assert cut.count() < dealt(runs, reach).count() / 5


def test_swapped_runs_are_compared_as_runs(spark):
    rng = random.Random(6)
    stored, runs = _made(spark, _rows(rng), False), _made(spark, _runs(rng), True)
    ids = spark.createDataFrame([("s",)], "new_id string")
    swapped = replace_series(stored, runs, ids)
    assert rows_of(expand(swapped)) == rows_of(replace_series(stored, expand(runs), ids))
    assert rows_of(diff.change_report(stored, swapped)) == rows_of(diff.change_report(stored, expand(swapped)))
