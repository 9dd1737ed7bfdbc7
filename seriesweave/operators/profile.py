"""What a history looks like: summaries and outages of every series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.predicates import (
    state_unavailable,
    statistics_unavailable,
    text_marks,
)
from ..functions.text import number_text, value_with_sum
from ..functions.times import local_time
from ..plans.segments import segments
from ..plans.timeline import DEFAULT_CHUNKING, Chunking
from ..schema import DISPLAY_COLUMNS, MARKS

ENDS = ("earliest", "latest", "earliest_available", "latest_available")


def _summary(rows: DataFrame, *keys: str) -> DataFrame:
    # One pass with map-side combine. min/max of structs order by time, then row
    # id, with rows that have no time first.
    available = F.when(~F.col("unavailable"), F.col("entry"))
    ends = {
        "earliest": F.min("entry"),
        "latest": F.max("entry"),
        "earliest_available": F.min(available),
        "latest_available": F.max(available),
    }
    return rows.groupBy(*keys).agg(
        F.count("*").alias("row_count"),
        F.count_if("unavailable").alias("unavailable_count"),
        *(e.alias(n) for n, e in ends.items()),
    ).select(
        *keys,
        "row_count",
        "unavailable_count",
        *(
            F.when(
                F.col(n).isNotNull(),
                F.struct(F.col(n)["ts"].alias("ts"), F.col(n)["value"].alias("value"), F.col(n)["sum"].alias("sum")),
            ).alias(n)
            for n in ENDS
        ),
    )


def summarize_states(states: DataFrame) -> DataFrame:
    """One row per series: counts and first / last rows, over all and over available rows."""
    return _summary(
        states.select(
            "series_id",
            F.lit("states").alias("table"),
            state_unavailable().alias("unavailable"),
            F.struct(
                "ts", "row_id", F.col("state").alias("value"), F.lit(None).cast("double").alias("sum")
            ).alias("entry"),
        ),
        "series_id",
        "table",
    )


def summarize_statistics(statistics: DataFrame) -> DataFrame:
    """The same per series and statistics table; ``value`` is the number shown for a row."""
    return _summary(
        statistics.select(
            "series_id",
            "table",
            statistics_unavailable().alias("unavailable"),
            F.struct(
                F.col("start_ts").alias("ts"),
                "row_id",
                F.coalesce(*DISPLAY_COLUMNS[:-1]).alias("value"),
                "sum",
            ).alias("entry"),
        ),
        "series_id",
        "table",
    )


def summarize_all(states: DataFrame, statistics: DataFrame, total_increasing: Column | None = None) -> DataFrame:
    """States and both statistics tables, one row per (series, table), values as text.

    The entries of available rows are NULL where they equal those of all rows, and
    hold NULLs where nothing is available. ``total_increasing`` tells for which
    series a sum belongs to the value.
    """
    with_sum = F.lit(False) if total_increasing is None else total_increasing
    statistics_rows = summarize_statistics(statistics).withColumns(
        {
            n: F.when(
                F.col(n).isNotNull(),
                F.struct(
                    F.col(f"{n}.ts").alias("ts"),
                    number_text(F.col(f"{n}.value")).alias("value"),
                    F.when(with_sum & F.col(f"{n}.value").isNotNull(), F.col(f"{n}.sum")).alias("sum"),
                ),
            )
            for n in ENDS
        }
    )
    nothing = F.lit(None)
    empty = F.struct(
        nothing.cast("double").alias("ts"), nothing.cast("string").alias("value"), nothing.cast("double").alias("sum")
    )
    shown = {n: F.coalesce(n, empty) for n in ENDS}
    return summarize_states(states).unionByName(statistics_rows).select(
        "series_id",
        "table",
        "row_count",
        "unavailable_count",
        *(shown[n].alias(n) for n in ("earliest", "latest")),
        *(
            F.when(~shown[f"{n}_available"].eqNullSafe(shown[n]), shown[f"{n}_available"]).alias(f"{n}_available")
            for n in ("earliest", "latest")
        ),
    )


def summary_paths(summary: DataFrame) -> DataFrame:
    """A ``summarize_all`` frame as ``(series_id, path, value)``; a NULL value means null."""

    def cell(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def entry(name: str) -> Column:
        shown = value_with_sum(F.col(f"{name}.value"), number_text(F.col(f"{name}.sum")))
        cells = F.array(cell(f"{name}/ts", local_time(F.col(f"{name}.ts"))), cell(f"{name}/value", shown))
        return F.when(F.col(name).isNotNull(), cells).otherwise(F.slice(cells, 1, 0))

    counts = F.array(*(cell(n, F.col(n).cast("string")) for n in ("row_count", "unavailable_count")))
    return summary.select(
        "series_id", "table", F.explode(F.concat(counts, *(entry(n) for n in ENDS))).alias("cell")
    ).select(
        "series_id", F.concat("table", F.lit("/"), "cell.name").alias("path"), F.col("cell.value").alias("value")
    )


def earliest_state(states: DataFrame) -> DataFrame:
    """Time of the first row per series."""
    return states.groupBy("series_id").agg(F.min("ts").alias("ts"))


def latest_statistics(statistics: DataFrame) -> DataFrame:
    """Time of the last row per series and table."""
    return statistics.groupBy("series_id", "table").agg(F.max("start_ts").alias("ts"))


def last_reset_rows(statistics: DataFrame, last_reset_as: str | None = None) -> DataFrame:
    """Statistics rows that carry a reset mark, in the form that their table keeps it.

    Rows read with ``layout`` say themselves which form that is, and the result has both columns,
    one of them NULL. Otherwise it is ``epoch`` unless ``last_reset_as`` tells.
    """
    if last_reset_as is None and MARKS in statistics.columns:
        text = text_marks(statistics)
        marks = {"last_reset_ts": F.when(~text, F.col("last_reset_ts")), "last_reset": F.when(text, F.col("last_reset"))}
        rows = statistics.select("series_id", "table", "start_ts", *(m.alias(n) for n, m in marks.items()))
        return rows.where("last_reset_ts is not null or last_reset is not null")
    mark = "last_reset" if last_reset_as == "text" else "last_reset_ts"
    return statistics.where(F.col(mark).isNotNull()).select("series_id", "table", "start_ts", mark)


def _outages(rows: DataFrame, max_rows: int | None, chunking: Chunking) -> DataFrame:
    """Runs of unavailable rows as (series_id, table, start_ts, end_ts, row_count, value).

    A run also ends where ``text``, if there is one, changes; see ``plans.segments`` for how runs are found. With
    ``max_rows``, series with more unavailable rows are left out as a whole.
    """
    keys = ["series_id", "table"]
    if max_rows is not None:
        counts = rows.where("unavailable").groupBy(*keys).agg(F.count("*").alias("_n"))
        rows = rows.join(counts.where(F.col("_n") > max_rows), keys, "left_anti")
    values = ["unavailable"]
    if "text" in rows.columns:
        # Texts of available rows do not matter: a whole stretch of them is one segment.
        rows, values = rows.withColumn("text", F.when(F.col("unavailable"), F.col("text"))), ["unavailable", "text"]
    runs = segments(rows, keys, ["ts", "row_id"], values, chunking)
    value = F.coalesce("text", F.lit("NULL")) if "text" in values else F.lit("NULL")
    return runs.where("unavailable and start_ts is not null").select(*keys, "start_ts", "end_ts", "row_count", value.alias("value"))


def state_outages(states: DataFrame, max_rows: int | None = None, chunking: Chunking = DEFAULT_CHUNKING) -> DataFrame:
    """Runs of unavailable states with the same exact text."""
    rows = states.select(
        "series_id",
        F.lit("states").alias("table"),
        "ts",
        "row_id",
        state_unavailable().alias("unavailable"),
        F.col("state").alias("text"),
    )
    return _outages(rows, max_rows, chunking)


def statistics_outages(
    statistics: DataFrame, max_rows: int | None = None, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Runs of statistics rows without any value."""
    rows = statistics.select(
        "series_id",
        "table",
        F.col("start_ts").alias("ts"),
        "row_id",
        statistics_unavailable().alias("unavailable"),
    )
    return _outages(rows, max_rows, chunking)


def outages(
    states: DataFrame, statistics: DataFrame, max_rows: int | None = None, chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Outage runs of states and of both statistics tables."""
    return state_outages(states, max_rows, chunking).unionByName(
        statistics_outages(statistics, max_rows, chunking)
    )
