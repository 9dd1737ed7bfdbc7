"""Neighbouring rows of a series without putting a whole series into one task.

A window over ``series_id`` alone sorts the complete history of a series in one
task, and one series may hold a third of the table. Here the history of a series
is cut into cells, spans of time (a day, unless told otherwise), and rows are
dealt out by (series, cell) explicitly: were that left to the planner, rows that a
join has just dealt out by series would stay where they are. Window functions run
per cell. What crosses a cell's border is a few rows per cell, carried over in a
second, small window. There is one plan for all sizes: nothing is counted first,
and nothing is written in between.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

CELL = "_cell"
# Sorts before every real cell, as rows without a time sort first.
_NO_TIME = -(2**62)


@dataclass(frozen=True)
class Chunking:
    """How long a cell is. A task sorts the rows of one series in that time, spilling if it must."""

    span_seconds: int = 86_400


DEFAULT_CHUNKING = Chunking()


def cell_of(time: str | Column, chunking: Chunking) -> Column:
    """Number of the cell that a time falls in."""
    time = F.col(time) if isinstance(time, str) else time
    return F.coalesce(F.floor(time / F.lit(float(chunking.span_seconds))), F.lit(_NO_TIME))


def split_cells(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunking: Chunking, cell: Column | None = None, partitions: int | None = None
) -> DataFrame:
    """Add ``_cell`` (spans of time, or the finer ``cell``) and deal rows out by first key and cell.

    Further keys stay together: one that is a literal would make the planner shuffle again. Without a number of
    ``partitions`` Spark joins small ones.
    """
    cell = cell_of(order[0], chunking) if cell is None else F.coalesce(cell, F.lit(_NO_TIME))
    return df.withColumn(CELL, cell).repartition(*([partitions] if partitions else []), keys[0], CELL)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, chunking: Chunking) -> DataFrame:
    """Add the sum of ``value`` up to and with each row of its key, in order.

    Sums run inside cells; those of earlier cells are added from one row per cell.
    """
    cells = df.withColumns({"_value": value, CELL: cell_of(order[0], chunking)})
    along = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    earlier = cells.groupBy(*keys, CELL).agg(F.sum("_value").alias("_sum"))
    earlier = earlier.select(*keys, CELL, F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*keys, CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.repartition(*keys, CELL).withColumn("_inside", F.sum("_value").over(inside))
    total = (F.col("_inside") + F.col("_earlier")).alias(name)
    return summed.join(earlier, [*keys, CELL]).select(*df.columns, total)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, Column],
    known: Mapping[str, Column] | None = None,
    chunking: Chunking = DEFAULT_CHUNKING,
) -> DataFrame:
    """Add values of earlier rows of the same series.

    ``previous`` names expressions (structs, so that "no row" and "NULL value"
    differ) taken from the row directly before. ``known`` names expressions whose
    last non-NULL value before the row is taken; it is only given on rows where the
    expression itself is not NULL. Rows with equal order columns keep an arbitrary
    order among themselves.

    All but a few rows per cell find their answer inside the cell. The others,
    the border rows, are looked at once more along the whole series. Both branches
    read the same shuffle, which Spark runs once.
    """
    known = known or {}
    names = [*previous, *known]
    columns = df.columns
    rows = split_cells(df, keys, order, chunking)
    rows = rows.withColumns({f"_here_{n}": value for n, value in {**previous, **known}.items()})

    inside = Window.partitionBy(*keys, CELL).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            **{n: F.lag(f"_here_{n}").over(inside) for n in previous},
            **{n: F.last(f"_here_{n}", ignorenulls=True).over(so_far) for n in known},
            "_is_first": ~F.lag(F.lit(True), 1, False).over(inside),
            "_is_last": ~F.lead(F.lit(True), 1, False).over(inside),
        }
    )
    at_border = F.col("_is_first") | F.col("_is_last")
    for n in known:
        at_border = at_border | (F.col(f"_here_{n}").isNotNull() & F.col(n).isNull())

    across = Window.partitionBy(*keys).orderBy(CELL, *order)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    leaving = lambda n: F.when(F.col("_is_last"), F.coalesce(f"_here_{n}", n))
    border = rows.where(at_border).withColumns(
        {
            **{n: F.coalesce(n, F.lag(f"_here_{n}").over(across)) for n in previous},
            **{n: F.coalesce(n, F.last(leaving(n), ignorenulls=True).over(before)) for n in known},
        }
    )
    return rows.where(~at_border).select(*columns, *names).unionByName(border.select(*columns, *names))
