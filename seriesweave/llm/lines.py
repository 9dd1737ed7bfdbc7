"""Line dedup by site-relative frequency.

For every site, the share of its pages that hold a line; lines above the boilerplate ratio
are dropped. A line counts once per page; white space around it does not matter, and blank
lines are neither counted nor dropped. Lines are compared by 64-bit hashes. A page made of
such lines only is left alone: copies of whole pages are for document dedup, and no page is
emptied.

All steps are DataFrame functions. Counting combines before its shuffle, so no line, however
common, and no site lands in one task. A site has at most (lines per page / ratio) dropped
lines; they are joined to its pages as one array, and adaptive execution splits hot sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.1
LEAST_PAGES = 3
BLANK = " \t\r\x0b\x0c"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _hash(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def _boilerplate(pages: DataFrame, ratio: float, least: int) -> DataFrame:
    """_site and drop, the array of line hashes above the ratio, for sites that have any; pages: site, text."""
    sites = pages.groupBy(F.col("site").alias("_site")).agg(F.count("*").alias("pages"))
    own = F.transform(F.filter(F.split("text", "\n"), lambda x: _bare(x) != ""), _hash)
    lines = pages.select(F.col("site").alias("_at"), F.explode(F.array_distinct(own)).alias("line"))
    counts = lines.groupBy("_at", "line").agg(F.count("*").alias("on")).filter(F.col("on") >= least)
    common = counts.join(sites, F.col("_at").eqNullSafe(F.col("_site"))).filter(F.col("on") > ratio * F.col("pages"))
    return common.groupBy("_site").agg(F.collect_list("line").alias("drop"))


def drop_boilerplate(
    pages: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES
) -> DataFrame:
    """pages with cleaned text, plus lines_total and lines_dropped (in place of columns of those names).

    A null site is a site of its own. A null text stays null and has no lines; an empty one
    has one blank line. Repeated pages count as often as they occur. Sites are measured over
    all their pages; a line on fewer than `least` pages is never dropped.
    """
    drop = _boilerplate(pages.select(F.col(site).alias("site"), F.col(text).alias("text")), ratio, least)
    rows = pages.select(F.struct("*").alias("row"), F.col(site).alias("site"))
    rows = rows.join(drop, F.col("site").eqNullSafe(F.col("_site")), "left")
    rows = rows.withColumn("text", F.col(f"row.`{text}`")).withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("hit", F.array_intersect(F.transform("lines", _hash), F.col("drop")))
    kept = F.filter("lines", lambda x: (_bare(x) == "") | ~F.array_contains("hit", _hash(x)))
    rows = rows.withColumn("kept", F.when(F.size("hit") > 0, kept).otherwise(F.col("lines")))
    rows = rows.withColumn("kept", F.when(F.exists("kept", lambda x: _bare(x) != ""), F.col("kept")).otherwise(F.col("lines")))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines"))
    dropped = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines") - F.size("kept"))
    clean = F.when(dropped > 0, F.concat_ws("\n", "kept")).otherwise(F.col("text"))
    own = [c for c in pages.columns if c not in ("lines_total", "lines_dropped")]
    return rows.select(
        *(clean.alias(c) if c == text else F.col(f"row.`{c}`") for c in own), total.alias("lines_total"), dropped.alias("lines_dropped")
    )
