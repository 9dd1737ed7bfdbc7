"""The whole job: which pairs can be spliced, the rebuilt statistics, and their checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from ..plans.runs import expand
from ..plans.timeline import DEFAULT_CHUNKING, Chunking
from ..schema import INTERVALS, KINDS, TOTAL_KINDS
from ..sources.sinks import replace_series, staged
from .diff import change_report, planned_changes, planned_changes_condensed, versions
from .generate import generate_runs, generated_counts, preview
from .profile import latest_statistics, summarize_states
from .quality import missing_rows, statistics_resets


def eligibility(
    pairs: DataFrame,
    classes: DataFrame,
    states: DataFrame,
    statistics: DataFrame | None = None,
    statistics_meta: DataFrame | None = None,
) -> DataFrame:
    """``pairs(old_id, new_id)`` with ``kind``, ``eligible`` and the ``reason`` if not.

    Both sensors must have the same supported class, both must have available
    states, and the successor's must begin in a later second than the
    predecessor's end. With the id dictionary ``statistics_meta`` of the table to be
    written the successor must have an id there. ``overlaps_statistics`` tells whether
    they begin before the end of the predecessor's statistics, which does not rule a
    pair out.
    """
    # Both sides of all pairs look things up together, so states are read once.
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"{name}_id").alias("series_id"))
    facts = summarize_states(states).select(
        "series_id",
        F.col("earliest_available.ts").alias("available_from"),
        F.col("latest_available.ts").alias("available_to"),
    )
    looked_up = (
        pairs.select("old_id", "new_id", F.explode(F.array(side("old"), side("new"))).alias("of"))
        .select("old_id", "new_id", "of.side", "of.series_id")
        .join(classes.select("series_id", "state_class"), "series_id", "left")
        .join(facts, "series_id", "left")
    )
    found = {
        "old_class": ("old", "state_class"),
        "new_class": ("new", "state_class"),
        "old_end": ("old", "available_to"),
        "new_start": ("new", "available_from"),
    }
    if statistics is not None:
        ends = latest_statistics(statistics).groupBy("series_id").agg(F.max("ts").alias("statistics_end"))
        looked_up = looked_up.join(ends, "series_id", "left")
        found["statistics_end"] = ("old", "statistics_end")
    if statistics_meta is not None:
        targets = statistics_meta.select(F.col("statistic_id").alias("series_id")).distinct()
        looked_up = looked_up.join(targets.withColumn("has_target", F.lit(True)), "series_id", "left")
        found["has_target"] = ("new", "has_target")
    both = looked_up.groupBy("old_id", "new_id").agg(
        *(F.max(F.when(F.col("side") == of, F.col(column))).alias(name) for name, (of, column) in found.items())
    )

    reason = (
        F.when(
            F.col("old_class").isNull()
            | ~F.col("old_class").eqNullSafe(F.col("new_class"))
            | ~F.col("old_class").isin(*KINDS),
            "classes differ or are not supported",
        )
        .when(F.col("old_end").isNull() | F.col("new_start").isNull(), "no available states")
        .when(F.floor("new_start") <= F.floor("old_end"), "new states start before old states end")
    )
    if statistics_meta is not None:
        reason = reason.when(F.col("has_target").isNull(), "no target id")
    overlaps = F.coalesce(F.col("new_start") <= F.col("statistics_end"), F.lit(False)).alias("overlaps_statistics")
    return both.select(
        "old_id",
        "new_id",
        F.col("old_class").alias("kind"),
        "old_end",
        "new_start",
        reason.isNull().alias("eligible"),
        reason.alias("reason"),
        *([] if statistics is None else [overlaps]),
    )


def quality_checks(
    generated: DataFrame, replacements: DataFrame, chunking: Chunking = DEFAULT_CHUNKING
) -> dict[str, DataFrame]:
    """Missing rows of all generated series, and resets of those that count."""
    kinds = replacements.where(F.col("kind").isin(*TOTAL_KINDS)).select(F.col("new_id").alias("series_id"), "kind")
    return {
        "gaps": missing_rows(generated, chunking),
        "resets": statistics_resets(generated.join(kinds, "series_id"), F.col("kind"), chunking=chunking),
    }


def applied_changes(
    before: DataFrame, after: DataFrame, statistics: DataFrame, replacements: DataFrame
) -> DataFrame:
    """Changes between two stored versions, after the end of the predecessors in ``statistics``."""
    return change_report(*versions(before, after, statistics, replacements))


class Parts(Mapping):
    """Frames by name; a plan is built once, on first use."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders, self._built = builders, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def splice(
    pairs: DataFrame,
    classes: DataFrame,
    states: DataFrame,
    statistics: DataFrame,
    *,
    statistics_meta: DataFrame | None = None,
    tables: Mapping[str, int] = INTERVALS,
    started_from_0: bool = True,
    last_reset_as: str = "epoch",
    run_ts: float | None = None,
    chunking: Chunking = DEFAULT_CHUNKING,
    stage: str | None = None,
) -> Mapping[str, DataFrame]:
    """Run the job for all pairs and return its parts by name, each planned when it is first asked for.

    ``eligibility``, ``generated``, ``counts``, ``gaps``, ``resets``, ``preview``,
    ``changes``, ``condensed`` and ``result``, the statistics after replacement
    (see ``sources.sinks`` for writing them).

    With ``stage``, a new folder that all machines share, the rebuilt statistics are written
    there once, as runs, and every part reads them: lost executors repeat a read, not the
    rebuild. A stage that an earlier job finished is read again and not rebuilt, one that it left
    unfinished is replaced. Without it nothing runs here, and every part rebuilds what it needs.
    """
    checked = eligibility(pairs, classes, states, statistics, statistics_meta)
    replacements = checked.where("eligible").select(
        "old_id", "new_id", "kind", F.lit(started_from_0).alias("started_from_0")
    )
    options = {"last_reset_as": last_reset_as, "run_ts": run_ts, "chunking": chunking}
    if stage is not None:
        checked = staged(checked, f"{stage}/eligibility")
        replacements = checked.where("eligible").select(
            "old_id", "new_id", "kind", F.lit(started_from_0).alias("started_from_0")
        )
    runs = generate_runs(states, statistics, replacements, tables, **options)
    if stage is not None:
        runs = staged(runs, f"{stage}/generated")
    generated = expand(runs)
    checks = lambda name: lambda: quality_checks(runs, replacements, chunking)[name]
    return Parts(
        {
            "eligibility": lambda: checked,
            "generated": lambda: generated,
            "counts": lambda: generated_counts(runs),
            "gaps": checks("gaps"),
            "resets": checks("resets"),
            "preview": lambda: preview(runs, statistics, replacements),
            "changes": lambda: planned_changes(statistics, runs, replacements),
            "condensed": lambda: planned_changes_condensed(statistics, runs, replacements),
            "result": lambda: replace_series(statistics, generated, replacements, list(tables)),
        }
    )
