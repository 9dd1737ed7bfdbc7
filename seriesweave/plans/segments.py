"""Runs of equal rows, from mergeable summaries of cells.

The rows of a series are shuffled once, by (series, cell). In its cell every stretch of rows
with equal values folds to one segment: its first and last time and its number of rows. Two
neighbouring segments with equal values merge into one, and that merge is associative, so the
rows are not needed again: inner segments of a cell are final, and only its first and last one,
at most two per cell, are merged along the series.

Both shuffles have a fixed number of partitions. Shuffled rows are packed far below what they take
in sorts and hash tables, so tasks that are joined by packed size take gigabytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from .timeline import CELL, DEFAULT_CHUNKING, Chunking, split_cells


def _same(values: Sequence[str], before: Column) -> Column:
    """The struct ``before`` exists and holds the values of this row."""
    return before.isNotNull() & reduce(and_, (F.col(v).eqNullSafe(before[v]) for v in values))


def segments(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], chunking: Chunking = DEFAULT_CHUNKING
) -> DataFrame:
    """Maximal stretches of rows with equal ``values`` as (keys, values, start_ts, end_ts, row_count).

    ``order`` begins with the time; rows without one come first, and ``start_ts`` is the first
    time that is known. Rows with equal order columns keep an arbitrary order among themselves.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = split_cells(rows.select(*keys, *order, *values), keys, order, chunking, partitions=partitions)
    inside = Window.partitionBy(*keys, CELL).orderBy(*order)
    begins = F.when(_same(values, F.lag(F.struct(*values)).over(inside)), 0).otherwise(1)
    numbered = split.withColumn("_begins", begins).withColumn(
        "_segment", F.sum("_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    # Values are part of the key, as buffers of fixed width can be aggregated by hashing; rows lie where they are needed.
    folded = numbered.groupBy(*keys, CELL, "_segment", *values).agg(
        F.min(order[0]).alias("start_ts"), F.max(order[0]).alias("end_ts"), F.count("*").alias("row_count")
    )
    cell = Window.partitionBy(*keys, CELL)
    folded = folded.withColumn("_segments", F.max("_segment").over(cell))
    inner = (F.col("_segment") > 1) & (F.col("_segment") < F.col("_segments"))
    done = [*keys, *values, "start_ts", "end_ts", "row_count"]

    along = Window.partitionBy(*keys).orderBy(CELL, "_segment")
    # Only the first segment of a cell may go on from the one before it, the last one of another cell.
    goes_on = (F.col("_segment") == 1) & _same(values, F.lag(F.struct(*values)).over(along))
    border = folded.where(~inner).repartition(partitions, keys[0]).withColumn("_begins", F.when(goes_on, 0).otherwise(1))
    border = border.withColumn("_run", F.sum("_begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = border.groupBy(*keys, "_run", *values).agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("row_count").alias("row_count")
    )
    return folded.where(inner).select(*done).unionByName(merged.select(*done))
