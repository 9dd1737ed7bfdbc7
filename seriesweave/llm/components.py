"""Connected components of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesweave.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all ends of links(a, b).

    Every round takes the least label among a node and its neighbours, then the label of
    that label; each is written to the shared folder. Hubs meet in joins that adaptive
    execution splits and in minima that combine before the shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "both")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        least = labels.join(seen, "node").select("node", F.least("component", "seen").alias("component"), F.col("component").alias("was"))
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = least.join(of, "component").select("node", F.least("component", "next").alias("component"), "was")
        jumped = written(jumped, "labels")
        if jumped.filter(F.col("component") != F.col("was")).isEmpty():
            return labels
        labels = jumped.select("node", "component")
