"""Positions in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesweave.llm.tables import written

_WITHIN = (1 << 33) - 1


def in_order(df: DataFrame, *order: Column, sums: tuple[str, ...] = (), leave: tuple[str, ...] = ()) -> DataFrame:
    """Add `position` (from 0) in the given order, and before_<c>, the sum of c over earlier rows.

    Columns named in `leave` serve the order alone and are left out of the result.

    Rows are range partitioned, sorted and written once with their place, so that retried
    tasks see the same order; offsets come from one total per partition. Give an order that
    tells rows apart: rows equal in all of it meet in one partition and are numbered as they come.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_place", F.monotonically_increasing_id()).drop(*leave), "ordered")
    part = F.shiftrightunsigned("_place", 33)
    totals = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{c}") for c in sums))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_from_{c}") for c in ("n", *sums)))
    out = placed.withColumn("_part", part)
    if sums:
        within = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns({f"_in_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    out = out.join(F.broadcast(starts), "_part")  # one row per partition
    out = out.withColumn("position", F.col("_from_n") + F.col("_place").bitwiseAND(F.lit(_WITHIN)))
    out = out.withColumns({f"before_{c}": F.col(f"_from_{c}") + F.col(f"_in_{c}") for c in sums})
    return out.drop("_part", "_place", "_from_n", *(f"_from_{c}" for c in sums), *(f"_in_{c}" for c in sums))
