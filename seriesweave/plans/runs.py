"""Run-length rows: one row stands for equal rows at every interval up to ``until_ts``.

Rebuilt statistics mostly repeat themselves: a bucket without readings takes over the values of
the one before. A run says so once. Whatever looks at neighbours, ends or counts works on runs;
single rows appear where somebody asks for them, after the last shuffle before that.

A run is a statistics row with ``until_ts``, the first start that is no longer part of it. A
frame without that column holds single rows. Runs of one series and table do not overlap, but
for rows with the same start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .timeline import CELL

UNTIL = "until_ts"
# Intervals per cell when runs are cut and dealt out.
SPAN = 288
KEYS = ("series_id", "table")


def is_runs(df: DataFrame) -> bool:
    return UNTIL in df.columns


def as_runs(rows: DataFrame) -> DataFrame:
    """Single rows as runs of one row each."""
    return rows if is_runs(rows) else rows.withColumn(UNTIL, F.col("start_ts") + F.col("interval_s"))


def last_start(df: DataFrame) -> Column:
    """Start of the last row that a run stands for."""
    return F.col(UNTIL) - F.col("interval_s") if is_runs(df) else F.col("start_ts")


def length() -> Column:
    """How many rows a run stands for; a row without a time is one row."""
    return F.coalesce(F.round((F.col(UNTIL) - F.col("start_ts")) / F.col("interval_s")).cast("bigint"), F.lit(1).cast("bigint"))


def row_count(df: DataFrame) -> Column:
    """Aggregate: the number of rows."""
    return F.sum(length()) if is_runs(df) else F.count("*")


def later_than(df: DataFrame, cut: Column) -> DataFrame:
    """The rows strictly after ``cut``; a run that begins before loses its first rows. A NULL cut keeps all."""
    if not is_runs(df):
        return df.where(cut.isNull() | (F.col("start_ts") > cut))
    start, step = F.col("start_ts"), F.col("interval_s")
    gone = F.greatest(F.floor((cut - start) / step) + 1, F.lit(0))
    kept = df.withColumn("start_ts", F.when(cut.isNull(), start).otherwise(start + gone * step))
    return kept.where(F.col("start_ts") < F.col(UNTIL))


def last_up_to(df: DataFrame, cut: Column) -> Column:
    """Start of a run's last row at or before ``cut``; NULL where it begins later."""
    start, step = F.col("start_ts"), F.col("interval_s")
    steps = F.least(F.floor((cut - start) / step), length() - 1) if is_runs(df) else F.lit(0)
    return F.when(start <= cut, start + steps * step)


def _cut(runs: DataFrame, reach: int) -> DataFrame:
    """Runs cut at the borders of cells and dealt out by cell, with ``_low`` and ``_high``: which of their rows a cell gets."""
    start, step = F.col("start_ts"), F.col("interval_s")
    wide, beyond = step * F.lit(SPAN), step * F.lit(reach)
    cells = F.sequence(F.floor((start - beyond) / wide), F.floor((F.col(UNTIL) - step + beyond) / wide))
    # A fixed number of partitions: their sizes before expanding tell nothing, so they must not be joined by size.
    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = as_runs(runs).withColumn(CELL, F.explode(cells)).repartition(partitions, *KEYS, CELL)
    low = F.greatest(F.ceil((F.col(CELL) * wide - beyond - start) / step), F.lit(0))
    high = F.least(F.ceil(((F.col(CELL) + 1) * wide + beyond - start) / step), length())
    return cut.withColumns({"_low": low, "_high": high}).where(F.col("_high") > F.col("_low"))


def _in_cell() -> Column:
    wide = F.col("interval_s") * F.lit(SPAN)
    return F.floor(F.col("start_ts") / wide) == F.col(CELL)


def dealt(runs: DataFrame, reach: int = 0) -> DataFrame:
    """Single rows of runs, dealt out by (series, table, ``_cell``), with ``_own``.

    Runs are cut at the borders of cells of SPAN intervals, shuffled, and only then expanded, so
    a long gap costs the shuffle one row per cell. With ``reach`` every cell also gets that many
    intervals of rows either side of it, marked by ``_own`` false.
    """
    rows = _cut(runs, reach).withColumn("_k", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
    rows = rows.withColumn("start_ts", F.col("start_ts") + F.col("_k") * F.col("interval_s"))
    return rows.drop("_k", "_low", "_high", UNTIL).withColumn("_own", _in_cell())


# Of a stretch: start of the run it is part of, and the numbers of its first row and of the first one after it.
STRETCH = ("_base", "_from", "_to")


def stretches(runs: DataFrame, reach: int = 0) -> DataFrame:
    """``dealt`` before rows are expanded: runs of a cell become single rows and stretches between them.

    A stretch is a piece of a run among whose rows no other row of its cell lies; ``start_ts`` is that of
    its first row. Single rows are stretches of one. ``from_stretches`` gives what ``dealt`` gives.
    Where several long runs share a cell's time, all its rows are single ones.
    """
    start, step = F.col("start_ts"), F.col("interval_s")
    rows = _cut(runs, reach).drop(UNTIL).withColumn("_base", start).withColumn("start_ts", start + F.col("_low") * step)
    others = [c for c in rows.columns if c not in (*KEYS, CELL, "start_ts", "_base", "_low", "_high")]
    order = Window.partitionBy(*KEYS, CELL).orderBy("start_ts")
    is_long = F.col("_high") > F.col("_low") + 1
    whole = F.struct("_base", "_low", "_high", *others)
    end = F.when(is_long, F.col("_base") + (F.col("_high") - 1) * step)
    rows = rows.withColumns(
        {
            "_next": F.lead("start_ts").over(order),
            # The only run that may reach beyond this row, as long runs do not meet.
            "_open": F.last(F.when(is_long, whole), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_meets": F.coalesce(is_long & (F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start_ts")), F.lit(False)),
        }
    ).withColumn("_meets", F.max("_meets").over(Window.partitionBy(*KEYS, CELL)))

    run = F.col("_open")
    at = lambda k: run["_base"] + k * run["interval_s"]
    # Rows of one run are told by their number: its nearest row is found by rounding, then compared.
    near = lambda t: F.round((t - run["_base"]) / run["interval_s"]).cast("bigint")
    here, there = near(F.col("start_ts")), near(F.col("_next"))
    after = F.greatest(F.when(at(here) <= F.col("start_ts"), here + 1).otherwise(here), run["_low"] + 1)
    until = F.least(F.when(at(there) < F.col("_next"), there + 1).otherwise(there), run["_high"])
    until = F.when(F.col("_next").isNull(), run["_high"]).otherwise(until)
    shared = (at(here) == F.col("start_ts")) & (here > run["_low"]) & (here < run["_high"])
    last = run.isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("start_ts")))
    own = F.struct("_base", "_low", "_high", *others)
    # (run, from, to)
    piece = lambda of, a, b: F.struct(of.alias("run"), a.cast("bigint").alias("_from"), b.cast("bigint").alias("_to"))
    single = F.transform(F.sequence(F.col("_low"), F.col("_high") - 1), lambda k: piece(own, k, k + 1))
    apart = F.array(
        piece(own, F.col("_low"), F.col("_low") + 1),
        F.when(last & shared, piece(run, here, here + 1)),
        F.when(last & (until > after), piece(run, after, until)),
    )
    # A row between others needs none of this.
    pieces = F.when(F.col("_meets"), single).otherwise(F.array_compact(apart))
    cells = rows.select(*KEYS, CELL, F.explode(pieces).alias("_piece"))
    found = cells.select(*KEYS, CELL, *(F.col(f"_piece.run.{c}").alias(c) for c in ("_base", *others)), "_piece._from", "_piece._to")
    return found.withColumn("start_ts", F.col("_base") + F.col("_from") * F.col("interval_s"))


def from_stretches(rows: DataFrame) -> DataFrame:
    """Every row that stretches stand for, with ``_own``."""
    rows = rows.withColumn("_k", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
    rows = rows.withColumn("start_ts", F.col("_base") + F.col("_k") * F.col("interval_s"))
    return rows.drop("_k", *STRETCH).withColumn("_own", _in_cell())


def expand(runs: DataFrame) -> DataFrame:
    """Every row that the runs stand for. Rows without a time are none."""
    return dealt(runs).drop(CELL, "_own") if is_runs(runs) else runs
