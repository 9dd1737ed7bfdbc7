"""What is wrong with a history: missing rows and counter resets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import falls, missing_rows as missing_between, whole_number
from ..functions.predicates import state_available, text_marks
from ..functions.text import number_text
from ..functions.times import reset_instant, text_epoch
from ..functions.variants import json_field
from ..plans.runs import is_runs, last_start
from ..plans.timeline import DEFAULT_CHUNKING, Chunking, with_previous
from ..schema import MARKS, TOTAL_KINDS, VALUE_COLUMNS

_EVENT = ("series_id", "table", "event_ts", "last_reset_ts", "before_ts", "before_value", "after_ts", "after_value")


def missing_rows(statistics: DataFrame, chunking: Chunking = DEFAULT_CHUNKING) -> DataFrame:
    """Gaps in regular statistics (rows or runs): the rows around each gap and how many are missing."""
    rows = statistics.select(
        "series_id", "table", "interval_s", "start_ts", last_start(statistics).alias("_last"), "row_id", "state", "sum"
    )
    return (
        with_previous(
            rows,
            ["series_id", "table"],
            ["start_ts", "row_id"],
            {"before": F.struct(F.col("_last").alias("start_ts"), "state", "sum")},
            chunking=chunking,
        )
        .withColumn("missing", missing_between(F.col("before.start_ts"), F.col("start_ts"), F.col("interval_s")))
        .where("missing > 0")
        .select(
            "series_id",
            "table",
            F.col("before.start_ts").alias("before_ts"),
            F.col("start_ts").alias("after_ts"),
            "missing",
            F.col("before.state").alias("before_state"),
            F.col("before.sum").alias("before_sum"),
            F.col("state").alias("after_state"),
            F.col("sum").alias("after_sum"),
        )
    )


def _mode(mode: str | Column) -> Column:
    return F.lit(mode) if isinstance(mode, str) else mode


def _uses_marks(mode: str | Column) -> bool:
    return not isinstance(mode, str) or mode == "total"


def _marked_again(mark: str) -> Column:
    """The reset mark differs from the last one seen."""
    return F.col(f"known_{mark}").isNotNull() & F.col(mark).isNotNull() & (F.col(mark) != F.col(f"known_{mark}"))


def state_resets(
    states: DataFrame, mode: str | Column = "total_increasing", chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Resets among the numeric states of each series.

    Mode ``total``: the ``last_reset`` attribute changed since it was last known.
    Any other mode: the value fell by more than a tenth. ``mode`` may be a column.
    """
    attribute = F.coalesce(json_field(F.col("attrs"), "last_reset"), json_field(F.col("attrs_fallback"), "last_reset"))
    rows = (
        states.where(state_available())
        .select(
            "series_id",
            F.lit("states").alias("table"),
            "ts",
            "row_id",
            "state",
            whole_number("state").alias("number"),
            _mode(mode).alias("mode"),
            *([reset_instant(attribute).alias("mark")] if _uses_marks(mode) else []),
        )
        .where("number is not null")
    )
    return _resets(rows, mode, F.lit("total_increasing"), chunking)


def statistics_resets(
    statistics: DataFrame,
    mode: str | Column | None = "total_increasing",
    last_reset_as: str | None = None,
    chunking: Chunking = DEFAULT_CHUNKING,
) -> DataFrame:
    """Resets among the statistics rows (or runs) of each series, per table.

    Mode ``total_increasing``: the value fell by more than a tenth; ``total``: the
    reset mark changed; anything else, or none: the value fell at all. The value of
    a row is its state if it has one (a sum may be free of resets by design), else
    its sum, mean, min or max. Whether a row's table keeps reset marks as epochs
    (``last_reset_ts``) or only as text (``last_reset``) is known from its layout (see
    ``canonical_statistics``), told by ``last_reset_as``, or else ``epoch``.
    """
    mode = "any" if mode is None else mode
    mixed = last_reset_as is None and MARKS in statistics.columns
    as_text, parsed = text_marks(statistics, last_reset_as), text_epoch(F.col("last_reset"))
    # A column renamed to its own name would keep Spark from sharing the shuffle below.
    epoch = parsed if last_reset_as == "text" else F.when(as_text, parsed).otherwise(F.col("last_reset_ts"))
    epoch = epoch.alias("last_reset_ts") if mixed or last_reset_as == "text" else F.col("last_reset_ts")
    value = F.coalesce(*VALUE_COLUMNS)
    text_mark = F.coalesce(whole_number("last_reset").cast("string"), F.col("last_reset"))
    mark = text_mark if last_reset_as == "text" else F.col("last_reset_ts").cast("string")
    if mixed:
        mark = F.when(as_text, text_mark).otherwise(mark)
    rows = statistics.where(value.isNotNull()).select(
        "series_id",
        "table",
        F.col("start_ts").alias("ts"),
        *([last_start(statistics).alias("last_ts")] if is_runs(statistics) else []),
        "row_id",
        number_text(value).alias("state"),
        value.alias("number"),
        F.coalesce(_mode(mode), F.lit("any")).alias("mode"),
        mark.alias("mark"),
        epoch,
    )
    return _resets(rows, mode, F.col("mode"), chunking)


def _resets(rows: DataFrame, mode: str | Column, fall_mode: Column, chunking: Chunking) -> DataFrame:
    by_mark = _uses_marks(mode)
    found = with_previous(
        rows,
        ["series_id", "table"],
        ["ts", "row_id"],
        {"before": F.struct(F.col("last_ts" if "last_ts" in rows.columns else "ts").alias("ts"), "state", "number")},
        {"known_mark": F.col("mark")} if by_mark else {},
        chunking,
    )
    fell = falls(F.col("number"), F.col("before.number"), fall_mode)
    reset = F.when(F.col("mode") == "total", _marked_again("mark")).otherwise(fell) if by_mark else fell
    shown = "last_reset_ts" if "last_reset_ts" in rows.columns else "mark"
    last_reset = F.col(shown) if shown in rows.columns else F.lit(None)
    if shown == "mark" and by_mark:
        last_reset = F.when(F.col("mode") == "total", last_reset)
    return found.where(reset).select(
        "series_id",
        "table",
        F.col("ts").alias("event_ts"),
        last_reset.cast("double").alias("last_reset_ts"),
        F.col("before.ts").alias("before_ts"),
        F.col("before.state").alias("before_value"),
        F.col("ts").alias("after_ts"),
        F.col("state").alias("after_value"),
    )


def reset_report(
    states: DataFrame,
    statistics: DataFrame,
    classes: DataFrame,
    tables: tuple[str, ...] = ("statistics", "statistics_short_term"),
    last_reset_as: str | None = None,
    chunking: Chunking = DEFAULT_CHUNKING,
) -> DataFrame:
    """Resets of states next to those of each statistics table, one report per table.

    ``classes(series_id, state_class)`` gives each series its mode; series of other
    classes than the counting ones do not appear. Order by ``report``, then
    ``event_ts`` with NULLs last, to print it.
    """
    counting = classes.where(F.col("state_class").isin(*TOTAL_KINDS)).select("series_id", "state_class")
    of_states = state_resets(states.join(counting, "series_id"), F.col("state_class"), chunking)
    wanted = statistics.where(F.col("table").isin(*tables)).join(counting, "series_id")
    of_statistics = statistics_resets(wanted, F.col("state_class"), last_reset_as, chunking)
    reports = F.array(*(F.lit(t) for t in tables))
    return (
        of_states.withColumn("report", F.explode(reports))
        .unionByName(of_statistics.withColumn("report", F.col("table")))
        .select("report", *_EVENT)
    )
