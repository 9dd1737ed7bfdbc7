"""What a rebuild changes: row-level differences of two versions of statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import change_text, number_text
from ..functions.times import local_time
from ..plans.runs import SPAN, STRETCH, UNTIL, as_runs, dealt, expand, from_stretches, is_runs, later_than, stretches
from ..plans.timeline import CELL
from ..schema import BLOCK_EDGE, TRIVIAL_CHANGES
from .generate import ends_of_predecessors

_KEYS = ["series_id", "table", "start_ts"]
_TEXTS = ("last_reset",)
_TIMES = ("last_reset_ts", "created_ts")
COMPARED = ("state", "sum", "mean", "min", "max", "last_reset", "last_reset_ts", "created_ts")


def snapshot(statistics: DataFrame, cut: DataFrame | None = None, fold: bool = True) -> DataFrame:
    """Rows with a usable time, strictly after the series' ``cut(series_id, table, cut_ts)`` if it has one.

    Of several rows with one start the one with the highest row id stands, unless
    ``fold`` is off because ``change_report`` follows, which does the same.
    """
    rows = statistics.where(F.col("start_ts").isNotNull())
    if cut is not None:
        rows = later_than(rows.join(cut, ["series_id", "table"], "left"), F.col("cut_ts")).drop("cut_ts")
    if not fold:
        return rows
    rows, statistics = expand(rows), statistics.drop(UNTIL)
    others = [c for c in statistics.columns if c not in (*_KEYS, "row_id")]
    newest = F.max(F.struct("row_id", *others)).alias("row")
    return rows.groupBy(*_KEYS).agg(newest).select(*_KEYS, "row.*").select(*statistics.columns)


def _same(name: str, before: Column, after: Column) -> Column:
    if name in _TIMES:
        # Times are shown to the second and compared likewise.
        before, after = before.cast("bigint"), after.cast("bigint")
    return before.eqNullSafe(after)


def _compared(before: DataFrame, after: DataFrame, columns: Sequence[str], reach: int) -> DataFrame:
    """The changed rows of ``change_report``, still dealt out by cell: with ``_cell`` and ``_own``, see ``plans.runs.dealt``.

    Of runs they are stretches, see ``plans.runs.stretches``: rows of one stretch change alike.

    Rows of both versions are dealt out once. Within a cell they are sorted by start and
    version, and the last row of every start looks back at the last old one: no aggregate over
    structs, and what follows finds its rows in order.
    """
    own = [*_KEYS, "interval_s", "row_id", *columns, UNTIL]
    side = lambda df, n: as_runs(df.where(F.col("start_ts").isNotNull())).select(*own, F.lit(n).alias("_side"))
    both = side(before, 0).unionByName(side(after, 1))
    of_runs = is_runs(before) or is_runs(after)
    rows = stretches(both, reach) if of_runs else dealt(both, reach)
    place = STRETCH if of_runs else ("_own",)
    order = Window.partitionBy("series_id", "table", CELL).orderBy("start_ts", "_side", "row_id", *columns)
    version = F.struct("start_ts", *columns)
    rows = rows.withColumns(
        {
            "_next": F.lead("start_ts").over(order),
            "old": F.last(F.when(F.col("_side") == 0, version), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).where("_next is null or _next <> start_ts")

    rows = rows.select(
        *_KEYS,
        "interval_s",
        CELL,
        *place,
        F.when(F.col("_side") == 1, F.struct(*columns)).alias("new"),
        F.when(F.col("old.start_ts") == F.col("start_ts"), F.col("old")).alias("old"),
    )
    old, new = (lambda name: F.col(f"old.{name}")), (lambda name: F.col(f"new.{name}"))
    # Which rows differ is decided first, and on plain columns.
    rows = rows.where(~reduce(and_, (_same(c, old(c), new(c)) for c in columns)))

    def change(name: str) -> Column:
        delta = F.lit(None).cast("double") if name in (*_TEXTS, *_TIMES) else new(name) - old(name)
        found = F.struct(old(name).alias("old"), new(name).alias("new"), delta.alias("delta"))
        return F.when(~_same(name, old(name), new(name)), found).alias(name)

    return rows.select(*_KEYS, "interval_s", CELL, *place, *(change(c) for c in columns))


def _rows(found: DataFrame) -> DataFrame:
    """Single rows of what ``_compared`` gives, with ``_own``."""
    return from_stretches(found) if "_from" in found.columns else found


def unequal_cells(before: DataFrame, after: DataFrame, columns: Sequence[str] = COMPARED) -> DataFrame:
    """``(series_id, table, cell)`` of the cells, SPAN intervals each, whose rows are not the same in both versions.

    Each version's rows of a cell fold to their number, a sum and an exclusive or of their 64-bit
    hashes; that combines before the shuffle, so one row per cell is shuffled and no row of
    data. Cells with the same rows in another order, or with the same repeated rows, are equal.
    """
    # A NULL leaves a hash as it is; the names in between tell which column it was.
    place = [x for c in (*_KEYS, "row_id", *columns) for x in (F.lit(c), F.col(c))]
    side = lambda df, n: df.where(F.col("start_ts").isNotNull()).select(
        "series_id", "table", _cell().alias("cell"), F.lit(n).alias("_side"), F.xxhash64(*place).alias("_hash")
    )
    rows = side(before, 0).unionByName(side(after, 1))
    of = lambda n, value: F.when(F.col("_side") == n, value)
    folds = {
        "count": lambda n: F.count(of(n, F.lit(1))),
        "sum": lambda n: F.sum(of(n, F.shiftrightunsigned("_hash", 32))),
        "bits": lambda n: F.bit_xor(of(n, F.col("_hash"))),
    }
    cells = rows.groupBy("series_id", "table", "cell").agg(*(f(n).alias(f"_{name}{n}") for name, f in folds.items() for n in (0, 1)))
    same = reduce(and_, (F.col(f"_{name}0").eqNullSafe(F.col(f"_{name}1")) for name in folds))
    return cells.where(~same).select("series_id", "table", "cell")


def _cell() -> Column:
    return F.floor(F.col("start_ts") / (F.col("interval_s") * F.lit(SPAN)))


def change_report_by_cells(before: DataFrame, after: DataFrame, columns: Sequence[str] = COMPARED) -> DataFrame:
    """``change_report`` of two versions, as rows, that are mostly the same.

    Only rows of ``unequal_cells`` meet; both versions are read twice for that, and columns that
    are not asked for do not count. Where few cells differ they are broadcast, and rows of
    equal cells are not shuffled.
    """
    cells = unequal_cells(before, after, columns)
    of = lambda df: df.withColumn("cell", _cell()).join(cells, ["series_id", "table", "cell"], "left_semi").drop("cell")
    return change_report(of(before), of(after), columns)


def change_report(before: DataFrame, after: DataFrame, columns: Sequence[str] = COMPARED) -> DataFrame:
    """Rows whose values differ between two versions, aligned by series, table and start.

    Every compared column becomes a struct ``(old, new, delta)``, NULL where both
    sides agree; ``delta`` is NULL for texts, times and one-sided values. Rows that
    exist on one side only compare against NULLs. Of several rows with one start
    the one with the highest row id stands. Either version may consist of runs.
    """
    return _rows(_compared(before, after, columns, 0)).drop(CELL, "_own").select(*_KEYS, "interval_s", *columns)


def condensed_report(
    before: DataFrame, after: DataFrame, trivial: Sequence[str] = TRIVIAL_CHANGES, columns: Sequence[str] = COMPARED
) -> DataFrame:
    """``condense`` of ``change_report``, with one shuffle for both.

    Every cell gets the few rows beyond its borders that its decisions look at before rows are
    shuffled, so changes are compared and condensed where they lie.
    """
    found = _compared(before, after, columns, BLOCK_EDGE + 1)
    if "_from" not in found.columns:
        return _kept(found, trivial, columns)
    kept = _kept(_ends_apart(found), trivial, columns)
    return from_stretches(kept.drop("_inner")).where("_own").select(*_KEYS, "interval_s", *columns, "omitted_before")


def _ends_apart(found: DataFrame) -> DataFrame:
    """Stretches with the rows at their ends as single ones, and ``_inner`` where a row's whole neighbourhood is in its stretch.

    Decisions look at BLOCK_EDGE + 1 rows either side, so those of inner rows do not depend on others; what is
    left of the stretch in the middle stays one row.
    """
    edge = BLOCK_EDGE + 1
    first, end = F.col("_from"), F.col("_to")
    piece = lambda a, b, inner: F.struct(a.alias("_from"), b.alias("_to"), inner.alias("_inner"))
    inner = lambda k: (k >= first + edge) & (k < end - edge)
    single = lambda a, b: F.transform(F.sequence(a, b - 1), lambda k: piece(k, k + 1, inner(k)))
    low, high = first + 2 * edge, end - 2 * edge
    middle = F.array(piece(low, high, F.lit(True)))
    pieces = F.when(low < high, F.concat(single(first, low), middle, single(high, end))).otherwise(single(first, end))
    rows = found.withColumn("_piece", F.explode(pieces)).withColumns({c: F.col(f"_piece.{c}") for c in ("_from", "_to", "_inner")})
    return rows.drop("_piece").withColumns({"start_ts": F.col("_base") + F.col("_from") * F.col("interval_s"), "_own": F.lit(True)})


def _any_change(columns: Sequence[str]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNotNull()
    return found


def changed_columns(report: DataFrame, columns: Sequence[str] = COMPARED) -> DataFrame:
    """Per series and table the sorted names of the columns that differ anywhere."""
    names = F.array(*(F.when(F.max(F.col(c).isNotNull()), F.lit(c)) for c in sorted(columns)))
    return report.groupBy("series_id", "table").agg(F.array_compact(names).alias("columns"))


def change_cells(report: DataFrame, columns: Sequence[str] = COMPARED) -> DataFrame:
    """The report with ``start`` and every change as text, empty where nothing changed."""

    def text(name: str, side: str) -> Column:
        value = F.col(f"{name}.{side}")
        if name in _TEXTS:
            return value
        return local_time(value) if name in _TIMES else number_text(value)

    return report.select(
        *_KEYS,
        local_time(F.col("start_ts")).alias("start"),
        *(
            F.when(F.col(c).isNull(), "")
            .otherwise(change_text(text(c, "old"), text(c, "new"), F.col(f"{c}.delta")))
            .alias(c)
            for c in columns
        ),
        *(c for c in ("omitted_before",) if c in report.columns),
    )


def condense(
    report: DataFrame, trivial: Sequence[str] = TRIVIAL_CHANGES, columns: Sequence[str] = COMPARED
) -> DataFrame:
    """Keep of each contiguous block its first and last rows and all rows that matter.

    A block is a stretch of changed rows exactly one interval apart. A row matters
    when a column other than the ``trivial`` ones changed. ``omitted_before`` is
    true where rows of the same block were left out just before a row.

    Whether a row is kept depends only on its nearest neighbours in time, so each
    row is also handed to the chunks it borders on, and windows run per chunk.
    """
    # A decision looks at BLOCK_EDGE rows either side, the marker at one more.
    start, interval = F.col("start_ts"), F.col("interval_s")
    reach, span = (BLOCK_EDGE + 1) * interval, SPAN * interval
    own, low, high = (F.floor(t / span) for t in (start, start - reach, start + reach))
    cells = F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high)))
    return _kept(report.withColumn(CELL, cells).withColumn("_own", F.col(CELL) == own), trivial, columns)


def _kept(rows: DataFrame, trivial: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows that ``condense`` keeps, of rows with ``_cell`` and ``_own``.

    With ``_inner``, such rows stand in the middle of a block, after rows that change as they do.
    """
    of_stretches = "_inner" in rows.columns
    names = [c for c in rows.columns if c not in ("_own", *(() if of_stretches else (CELL,)))]
    is_inner = F.col("_inner") if of_stretches else F.lit(False)
    start, interval = F.col("start_ts"), F.col("interval_s")
    rows = rows.withColumn("_matters", _any_change([c for c in columns if c not in trivial]))

    inside = Window.partitionBy("series_id", "table", "_cell").orderBy("start_ts")
    # _back0 tells whether the row before is one interval away, _back1 whether the
    # one before that is as far from it again, and so on; _ahead1 likewise forwards.
    time = lambda k: F.lag("start_ts", k).over(inside) if k > 0 else F.lead("start_ts", -k).over(inside) if k < 0 else start
    near = lambda later, earlier: F.coalesce(F.abs(later - earlier - interval) < 1e-6, F.lit(False))
    rows = rows.withColumns(
        {
            **{f"_back{k}": near(time(k), time(k + 1)) for k in range(BLOCK_EDGE + 1)},
            **{f"_ahead{k}": near(time(-k), time(1 - k)) for k in range(1, BLOCK_EDGE + 1)},
            "_mattered": F.lag("_matters", 1, False).over(inside),
        }
    )

    every = lambda names: reduce(and_, (F.col(n) for n in names))
    # In the middle of its block: BLOCK_EDGE neighbours on both sides.
    middle = every([*(f"_back{k}" for k in range(BLOCK_EDGE)), *(f"_ahead{k}" for k in range(1, BLOCK_EDGE + 1))])
    middle_before = every([*(f"_back{k}" for k in range(BLOCK_EDGE + 1)), *(f"_ahead{k}" for k in range(1, BLOCK_EDGE))])
    return (
        rows.where(F.col("_own") & (F.col("_matters") | ~(is_inner | middle)))
        .withColumn("omitted_before", F.when(is_inner, ~F.col("_matters")).otherwise(middle_before & ~F.col("_mattered")))
        .select(*names, "omitted_before")
    )


def versions(
    before: DataFrame, after: DataFrame, statistics: DataFrame, replacements: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The successors' rows of two versions after the end of their predecessors in ``statistics``."""
    cut = ends_of_predecessors(statistics, replacements).withColumnRenamed("end_ts", "cut_ts")
    successors = replacements.select(F.col("new_id").alias("series_id"))
    side = lambda df: snapshot(df.join(successors, "series_id", "left_semi"), cut, fold=False)
    return side(before), side(after)


def planned_changes(
    statistics: DataFrame, generated: DataFrame, replacements: DataFrame
) -> DataFrame:
    """What replacing the successors' rows would change, after the end of their predecessors."""
    return change_report(*versions(statistics, generated, statistics, replacements))


def planned_changes_condensed(statistics: DataFrame, generated: DataFrame, replacements: DataFrame) -> DataFrame:
    """The same, condensed; one shuffle of rows."""
    return condensed_report(*versions(statistics, generated, statistics, replacements))
