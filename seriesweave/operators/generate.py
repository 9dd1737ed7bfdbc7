"""Rebuild the statistics of a successor from its raw states and its predecessor.

The raw states are shuffled once, by (series, smallest bucket): each bucket folds
into one row that keeps its first and last reading, the sum of the deltas inside
it and min / max / sum / count. Such rows can be chained in order, so everything
that runs along a series (running sum, filling, hourly roll-up) works on at most
one row per series and bucket, never on raw states. Empty buckets are not joined
from a spine: every bucket row repeats itself up to the next one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import bucket, counted_delta, leading_number
from ..functions.predicates import state_available
from ..functions.times import reset_epoch
from ..functions.variants import json_field
from ..plans.runs import UNTIL, as_runs, expand, last_up_to, row_count
from ..plans.timeline import CELL, DEFAULT_CHUNKING, Chunking, split_cells
from ..schema import INTERVALS, STATISTICS, TOTAL_KINDS
from .profile import latest_statistics

def _fold_buckets(states: DataFrame, replacements: DataFrame, interval: int, chunking: Chunking) -> DataFrame:
    """One row per (series, bucket) of the usable states of all successors; ``_cell`` orders a series' rows."""
    wanted = replacements.select(F.col("new_id").alias("series_id"), "kind", "started_from_0")
    reset = F.coalesce(json_field(F.col("attrs"), "last_reset"), json_field(F.col("attrs_fallback"), "last_reset"))
    readings = (
        states.where(state_available())
        .join(wanted, "series_id")
        .select(
            "series_id",
            "kind",
            "started_from_0",
            "ts",
            "row_id",
            leading_number("state").alias("v"),
            F.when(F.col("kind") == "total", reset).alias("reset"),
        )
    )
    split = split_cells(readings, ["series_id"], ["ts", "row_id"], chunking, bucket("ts", interval))
    inside = Window.partitionBy("series_id", CELL).orderBy("ts", "row_id")
    previous = F.lag("v").over(inside)
    return (
        split.withColumns(
            {
                "bucket": bucket("ts", interval),
                "_first": previous.isNull(),
                "_last": F.lead("v").over(inside).isNull(),
                "_delta": counted_delta(F.col("v"), previous, F.col("reset"), F.lag("reset").over(inside), F.col("kind")),
            }
        )
        .groupBy("series_id", CELL)
        .agg(
            F.max("kind").alias("kind"),
            F.max("started_from_0").alias("started_from_0"),
            F.max("bucket").alias("bucket"),
            F.max(F.when(F.col("_first"), F.col("v"))).alias("first_v"),
            F.max(F.when(F.col("_first"), F.col("reset"))).alias("first_reset"),
            F.max(F.when(F.col("_last"), F.col("v"))).alias("last_v"),
            F.max(F.when(F.col("_last"), F.col("reset"))).alias("last_reset"),
            F.sum(F.when(~F.col("_first"), F.col("_delta")).otherwise(0.0)).alias("inner"),
            F.min("v").alias("min"),
            F.max("v").alias("max"),
            F.sum("v").alias("total"),
            F.count("*").alias("n"),
        )
    )


def _chain(folded: DataFrame) -> DataFrame:
    """Add the running sum over the buckets of each series, starting from 0."""
    along = Window.partitionBy("series_id").orderBy(CELL)
    previous = F.lag("last_v").over(along)
    start = F.when(F.col("kind").isin(*TOTAL_KINDS) & F.col("started_from_0"), F.col("first_v")).otherwise(0.0)
    link = F.when(previous.isNull(), start).otherwise(
        counted_delta(F.col("first_v"), previous, F.col("first_reset"), F.lag("last_reset").over(along), F.col("kind"))
    )
    return folded.withColumn("_added", link + F.col("inner")).withColumn(
        "running", F.sum("_added").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )


def _roll_up(chained: DataFrame, tables: Mapping[str, int]) -> DataFrame:
    """One row per (series, table, bucket of that table); rows without a time only counted above."""
    grains = F.array(*(F.struct(F.lit(t).alias("table"), F.lit(i).cast("bigint").alias("interval_s")) for t, i in tables.items()))
    last = F.struct(CELL, F.col("last_v").alias("state"), "running", "last_reset", "kind")
    return (
        chained.where("bucket is not null")
        .withColumn("grain", F.explode(grains))
        .select("*", "grain.table", "grain.interval_s")
        .withColumn("start", bucket("bucket", F.col("interval_s")))
        .groupBy("series_id", "table", "interval_s", "start")
        .agg(
            F.max(last).alias("last"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            (F.sum("total") / F.sum("n")).alias("mean"),
        )
        .select("series_id", "table", "interval_s", "start", "last.state", "last.running", "last.last_reset", "last.kind", "min", "mean", "max")
    )


def _fill(rolled: DataFrame, strict_cutoff: bool) -> DataFrame:
    """Each bucket as a run up to the next one; the last bucket is still being filled and left out.

    A series whose readings all lie in one bucket still yields that bucket unless
    ``strict_cutoff``. Reset marks are filled forward on their own.
    """
    along = Window.partitionBy("series_id", "table", "interval_s").orderBy("start")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    following = F.lead("start").over(along)
    only = F.lag("start").over(along).isNull() & following.isNull()
    until = F.col("following") if strict_cutoff else F.coalesce("following", F.when(F.col("only"), F.col("start") + F.col("interval_s")))
    epoch = F.when(F.trim("last_reset") != "", reset_epoch(F.col("last_reset")))
    return (
        rolled.withColumn("_epoch", epoch)
        .withColumns(
            {
                "following": following,
                "only": only,
                "last_reset": F.last("last_reset", ignorenulls=True).over(so_far),
                "last_reset_ts": F.last("_epoch", ignorenulls=True).over(so_far),
            }
        )
        .withColumn(UNTIL, until.cast("double"))
        .where(F.col(UNTIL).isNotNull())
    )


def predecessors(statistics: DataFrame, replacements: DataFrame, tables: Mapping[str, int] = INTERVALS) -> DataFrame:
    """Per successor and table what is looked up in its predecessor, from one pass over the statistics.

    ``base`` is the newest sum, from which sums go on, and ``end_ts`` the time of the last row.
    """
    summed = F.when(F.col("sum").isNotNull(), F.struct("start_ts", "row_id", "sum"))
    found = (
        statistics.where(F.col("table").isin(*tables))
        .groupBy(F.col("series_id").alias("old_id"), "table")
        .agg(F.max(summed)["sum"].alias("base"), F.max("start_ts").alias("end_ts"))
    )
    return replacements.join(found, "old_id").select(F.col("new_id").alias("series_id"), "table", "base", "end_ts")


def rebuilt_runs(
    states: DataFrame,
    statistics: DataFrame,
    replacements: DataFrame,
    tables: Mapping[str, int] = INTERVALS,
    *,
    last_reset_as: str = "epoch",
    strict_cutoff: bool = False,
    run_ts: float | None = None,
    chunking: Chunking = DEFAULT_CHUNKING,
    with_end: bool = False,
) -> DataFrame:
    """The rows rebuilt from the successors' states: ``schema.STATISTICS`` with ``until_ts``, see ``plans.runs``.

    ``with_end`` adds ``end_ts``, the time of the predecessor's last row.
    """
    # Buckets of every table are made of whole buckets of this length.
    finest = math.gcd(*tables.values())
    rolled = _roll_up(_chain(_fold_buckets(states, replacements, finest, chunking)), tables)
    base = predecessors(statistics, replacements, tables)
    if not with_end:
        base = base.drop("end_ts")

    counting = F.col("kind").isin(*TOTAL_KINDS)
    total = F.col("kind") == "total"
    measured = F.col("kind") == "measurement"
    created = F.lit(run_ts) if run_ts is not None else F.unix_seconds(F.current_timestamp())
    columns = {
        "start_ts": F.col("start").cast("double"),
        "row_id": F.lit(None).cast("bigint"),
        "state": F.col("state"),
        "sum": F.when(counting, F.coalesce("base", F.lit(0.0)) + F.col("running")),
        **{c: F.when(measured, F.col(c)) for c in ("mean", "min", "max")},
        "last_reset": F.when(total, F.col("last_reset")) if last_reset_as == "text" else F.lit(None).cast("string"),
        "last_reset_ts": F.when(total, F.col("last_reset_ts")) if last_reset_as == "epoch" else F.lit(None).cast("double"),
        "created_ts": created.cast("double"),
        UNTIL: F.col(UNTIL),
    }
    # Joined before filling, while there is a row for every occupied bucket only.
    filled = _fill(rolled.join(base, ["series_id", "table"], "left"), strict_cutoff)
    more = ["end_ts"] if with_end else []
    return filled.select("series_id", "table", "interval_s", *(c.alias(n) for n, c in columns.items()), *more)


def rebuilt_rows(
    states: DataFrame,
    statistics: DataFrame,
    replacements: DataFrame,
    tables: Mapping[str, int] = INTERVALS,
    **options,
) -> DataFrame:
    """The rows rebuilt from the successors' states, as ``schema.STATISTICS``; options as in ``rebuilt_runs``."""
    return expand(rebuilt_runs(states, statistics, replacements, tables, **options))


def copied_rows(
    statistics: DataFrame,
    replacements: DataFrame,
    tables: Mapping[str, int] = INTERVALS,
    *,
    last_reset_as: str = "epoch",
) -> DataFrame:
    """The predecessors' statistics under the successors' ids.

    Tables that keep reset marks as epochs lose the text form, but a mark that is
    only known as text is kept as an epoch; for tables that keep only the text the
    epoch is derived from it.
    """
    text = F.col("last_reset")
    derived = F.when(F.trim(text) != "", reset_epoch(text))
    if last_reset_as == "epoch":
        marks = {"last_reset_ts": F.coalesce("last_reset_ts", derived), "last_reset": F.lit(None).cast("string")}
    else:
        marks = {"last_reset_ts": derived}
    return (
        statistics.where(F.col("table").isin(*tables))
        .withColumnRenamed("series_id", "old_id")
        .join(replacements.select("old_id", F.col("new_id").alias("series_id")), "old_id")
        .withColumns(marks)
        .select(*STATISTICS.fieldNames())
    )


def generate(
    states: DataFrame,
    statistics: DataFrame,
    replacements: DataFrame,
    tables: Mapping[str, int] = INTERVALS,
    *,
    last_reset_as: str = "epoch",
    **options,
) -> DataFrame:
    """Complete statistics of all successors: copied rows, then rebuilt rows.

    ``replacements(old_id, new_id, kind, started_from_0)`` has one row per
    successor. Per kind: ``total_increasing`` fills state and sum, ``total`` also
    the reset mark, ``measurement`` state, mean, min and max. Nothing is removed
    where copied and rebuilt rows share a bucket. Options as in ``rebuilt_runs``.
    """
    copied = copied_rows(statistics, replacements, tables, last_reset_as=last_reset_as)
    return copied.unionByName(rebuilt_rows(states, statistics, replacements, tables, last_reset_as=last_reset_as, **options))


def generate_runs(
    states: DataFrame,
    statistics: DataFrame,
    replacements: DataFrame,
    tables: Mapping[str, int] = INTERVALS,
    *,
    last_reset_as: str = "epoch",
    **options,
) -> DataFrame:
    """What ``generate`` gives, as runs: ``plans.runs.expand`` of it has the same rows.

    Where a successor begins before its predecessor ends, rebuilt rows are single ones up to
    that end, so that no run reaches over a copied row.
    """
    copied = as_runs(copied_rows(statistics, replacements, tables, last_reset_as=last_reset_as))
    rebuilt = rebuilt_runs(states, statistics, replacements, tables, last_reset_as=last_reset_as, with_end=True, **options)
    step, shared = F.col("interval_s"), last_up_to(rebuilt, F.col("end_ts"))
    piece = lambda begin, until: F.struct(begin.alias("start_ts"), until.alias(UNTIL))
    single = F.transform(
        F.sequence(F.lit(0).cast("bigint"), ((shared - F.col("start_ts")) / step).cast("bigint")),
        lambda k: piece(F.col("start_ts") + k * step, F.col("start_ts") + (k + 1) * step),
    )
    rest = F.filter(F.array(piece(shared + step, F.col(UNTIL))), lambda p: p["start_ts"] < p[UNTIL])
    whole = F.array(piece(F.col("start_ts"), F.col(UNTIL)))
    pieces = rebuilt.withColumn("_piece", F.explode(F.when(shared.isNull(), whole).otherwise(F.concat(single, rest))))
    rebuilt = pieces.withColumns({c: F.col(f"_piece.{c}") for c in ("start_ts", UNTIL)})
    return copied.unionByName(rebuilt.select(*copied.columns))


def generated_counts(generated: DataFrame) -> DataFrame:
    """Rows per series and table."""
    return generated.groupBy("series_id", "table").agg(row_count(generated).alias("row_count"))


def ends_of_predecessors(statistics: DataFrame, replacements: DataFrame) -> DataFrame:
    """Per successor and table the time of its predecessor's last row, as ``end_ts``."""
    return (
        latest_statistics(statistics)
        .where("ts is not null")
        .select(F.col("series_id").alias("old_id"), "table", F.col("ts").alias("end_ts"))
        .join(replacements, "old_id")
        .select(F.col("new_id").alias("series_id"), "table", "end_ts")
    )


def preview(
    generated: DataFrame,
    statistics: DataFrame,
    replacements: DataFrame,
    first: int = 3,
    last: int = 3,
) -> DataFrame:
    """Per series and table: the last copied row, then the first and last rebuilt rows.

    ``part`` is ``copied``, ``generated`` or ``omitted``, the last for the one row
    that stands for ``omitted`` rows in between; ``position`` orders the rows. All
    rebuilt rows appear when there are at most ``first + last`` of them.

    Rebuilt rows are one interval apart, so the position of a row follows from its
    time and the first one's: one small aggregate, and no sorting of whole series. Of
    runs only the rows shown are expanded.
    """
    keys = ["series_id", "table"]
    values = ["state", "sum", "mean", "min", "max"]
    ends = ends_of_predecessors(statistics, replacements)
    runs = as_runs(generated).where("start_ts is not null").select(*keys, "interval_s", "start_ts", UNTIL, *values).join(ends, keys)
    end, start, step = F.col("end_ts"), F.col("start_ts"), F.col("interval_s")
    skipped = F.greatest(F.floor((end - start) / step) + 1, F.lit(0))
    later = F.when(start + skipped * step < F.col(UNTIL), start + skipped * step)
    runs = runs.withColumns({"copied": last_up_to(runs, end), "later": later})
    place = lambda ts: F.round((ts - F.col("begin")) / F.col("step")).cast("bigint") + 1
    bounds = (
        runs.groupBy(*keys)
        .agg(
            F.max("interval_s").alias("step"),
            F.max("copied").alias("copied_ts"),
            F.min("later").alias("begin"),
            F.max(F.when(F.col("later").isNotNull(), F.col(UNTIL) - step)).alias("finish"),
        )
        .withColumn("total", F.coalesce(place(F.col("finish")), F.lit(0)))
    )
    total, count = F.col("total"), lambda n: F.lit(n).cast("bigint")
    beyond = total - (first + last)
    from_to = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    wanted = F.concat(from_to(count(1), F.least(count(first), total)), from_to(F.greatest(count(first), total - last) + 1, total))
    own = F.when(
        F.col("later").isNotNull(), F.filter(wanted, lambda p: p.between(place(F.col("later")), place(F.col(UNTIL) - step)))
    ).otherwise(F.array().cast("array<bigint>"))
    copied = F.when(F.col("copied") == F.col("copied_ts"), F.array(count(0))).otherwise(F.array().cast("array<bigint>"))
    shown = (
        runs.join(bounds, keys)
        .withColumn("position", F.explode(F.concat(copied, own)))
        .withColumn("at", F.when(F.col("position") == 0, F.col("copied")).otherwise(F.col("begin") + (F.col("position") - 1) * F.col("step")))
        # Several copied rows may share the last time.
        .groupBy(*keys, "position")
        .agg(F.max(F.struct(F.col("at").alias("start_ts"), *values)).alias("row"))
        .select(
            *keys,
            F.when(F.col("position") == 0, "copied").otherwise("generated").alias("part"),
            "row.*",
            "position",
            F.lit(0).cast("bigint").alias("omitted"),
        )
    )
    marker = bounds.where(beyond > 0).select(
        *keys,
        F.lit("omitted").alias("part"),
        *(F.lit(None).cast("double").alias(c) for c in ("start_ts", *values)),
        F.lit(first + 1).cast("bigint").alias("position"),
        beyond.alias("omitted"),
    )
    return shown.unionByName(marker)
