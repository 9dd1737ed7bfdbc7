"""Mixing sources to target weights by pivotal dependent rounding.

A document is to be taken target / size-of-its-source times. Its whole copies are certain;
the fractions are rounded together, so that every source comes out near its target: two
documents meet, words move at random from one fraction to the other until one of them is 0
or 1, and the other goes on. Groups of about 64 documents of a source are reduced to one
each, then 64 of those, and so on: a tree of log64(n) narrow shuffles. Moves keep the
expected number of copies of every document and the words of the source; only the last
document of a source is rounded to the nearer number.

Random numbers are hashes of doc_id, so reruns agree. All steps are DataFrame functions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesweave.llm.ordering import in_order
from seriesweave.llm.tables import written

WORD = r"[^\x20\x09-\x0D]+"
FAN_IN = 64
NEAR = 1e-9
KEY = ("source", "source_size", "target")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    Sources take the weights in turn, by code point, null last, and share `share` of all
    words by them; no target is above `most` times its source, and what is cut off goes to
    the others by weight, until none is above. Each round is one aggregate over sources.
    """
    ranked = in_order(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("position") % len(weights) + 1).cast("int"))
    ranked = written(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    cap = most * F.col("source_size")
    goal, level, capped = None, math.inf, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        if goal is None:
            full = F.lit(False)
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.count(F.when(full, 1)).alias("n"),
            F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("weight"),
        ).first()
        goal = share * (row["all"] or 0)
        if row["n"] == capped or not row["weight"]:
            level = math.inf if not row["weight"] else level
            break
        capped, level = row["n"], (goal - (row["capped"] or 0.0)) / row["weight"]
    return ranked.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _unit(*values: Column) -> Column:
    """A number in [0, 1) from hashes."""
    return F.pmod(F.xxhash64(*values), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _meet(state: Column, x: Column) -> Column:
    """One pivotal step: the open document of the state and x, one of which is decided."""
    kind = "struct<size:bigint,u:bigint,doc_id:bigint,n:bigint,base:bigint,part:double>"
    r = state["open"]
    a, b = r["part"] * r["size"], x["part"] * x["size"]
    give, take = F.least(a, x["size"] - b), F.least(b, r["size"] - a)
    gives = _unit(r["u"], x["u"]) * (give + take) < take

    def item(y: Column, part: Column) -> Column:
        return F.struct(*(y[c].alias(c) for c in ("size", "u", "doc_id", "n", "base")), part.alias("part")).cast(kind)

    def decided(y: Column, up: int) -> Column:
        return F.struct(y["size"].alias("size"), y["doc_id"].alias("doc_id"), y["n"].alias("n"), (y["base"] + up).alias("copies"))

    new_open = F.when(
        gives, F.when(give == a, item(x, (b + give) / x["size"])).otherwise(item(r, (a - give) / r["size"]))
    ).otherwise(F.when(take == b, item(r, (a + take) / r["size"])).otherwise(item(x, (b - take) / x["size"])))
    done = F.when(gives, F.when(give == a, decided(r, 0)).otherwise(decided(x, 1))).otherwise(
        F.when(take == b, decided(x, 0)).otherwise(decided(r, 1))
    )
    return F.when(
        r.isNull(), F.struct(x.cast(kind).alias("open"), state["done"].alias("done"))
    ).otherwise(F.struct(new_open.alias("open"), F.concat(state["done"], F.array(done)).alias("done")))


def _level(items: DataFrame) -> DataFrame:
    """Reduce every group of a source to one open document."""
    empty = F.struct(
        F.lit(None).cast("struct<size:bigint,u:bigint,doc_id:bigint,n:bigint,base:bigint,part:double>").alias("open"),
        F.expr("cast(array() as array<struct<size:bigint,doc_id:bigint,n:bigint,copies:bigint>>)").alias("done"),
    )
    group = F.pmod("u", F.col("groups")).alias("group")
    gathered = items.groupBy(*KEY, "groups", group).agg(
        F.sort_array(F.collect_list(F.struct("size", "u", "doc_id", "n", "base", "part")), asc=False).alias("items")
    )
    return gathered.select(*KEY, "groups", F.aggregate("items", empty, _meet).alias("state"))


def decisions(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """How often the mix takes the documents of docs(doc_id, text, source, ...).

    Returns source, source_size, target, doc_id, size, n, copies: `copies` for all n rows
    that agree in source, doc_id and size together. A null text has size 0, a null source
    is a source. Sizes of 0 take no words; their copies are rounded one by one.
    """
    units = docs.select("source", "doc_id", word_count(F.col("text")).alias("size")).groupBy("source", "doc_id", "size")
    units = written(units.agg(F.count("*").alias("n")), "units")
    sizes = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units")
    )
    sizes = written(sizes, "sizes")
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    of = targets.withColumnRenamed("source", "_source").join(
        sizes.select(F.col("source").alias("_same"), "units"), F.col("_source").eqNullSafe(F.col("_same"))
    ).drop("_same")
    wanted = F.when(F.col("source_size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    items = units.join(of, units["source"].eqNullSafe(F.col("_source"))).drop("_source").withColumn("wanted", wanted)
    items = items.withColumn("base", F.floor(F.col("wanted") + NEAR)).withColumn("part", F.col("wanted") - F.col("base"))
    items = items.withColumn("u", F.xxhash64(F.lit(0), "doc_id", "size", "source"))
    items = items.withColumn("groups", F.ceil(F.col("units") / FAN_IN))
    items = written(items.select(*KEY, "doc_id", "size", "n", "base", "part", "u", "groups"), "items")
    alone = (F.col("part") <= NEAR) | (F.col("size") == 0)
    up = (F.col("size") == 0) & (_unit(F.col("u")) < F.col("part")) & (F.col("part") > NEAR)
    columns = [*KEY, "doc_id", "size", "n"]
    decided = [items.filter(alone).select(*columns, (F.col("base") + up.cast("long")).alias("copies"))]
    groups = sizes.agg(F.max("units")).first()[0] or 0
    level = items.filter(~alone)
    while True:
        folded = written(_level(level), "folded")
        done = folded.select(*KEY, F.explode("state.done").alias("d"))
        decided.append(done.select(*KEY, "d.doc_id", "d.size", "d.n", "d.copies"))
        groups = math.ceil(groups / FAN_IN)
        last = folded.select(*KEY, "groups", "state.open.*")
        if groups <= 1:
            break
        # A new hash, as the old one is the same in all of a group's rows modulo the number of groups.
        level = last.withColumn("u", F.xxhash64("u")).withColumn("groups", F.ceil(F.col("groups") / FAN_IN))
    decided.append(last.select(*columns, (F.col("base") + (F.col("part") >= 0.5).cast("long")).alias("copies")))
    return reduce(DataFrame.unionByName, decided)


def mix_sizes(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies.

    Repeated rows share their copies, the first of them getting one more where they don't divide.
    """
    each = decisions(docs, weights, share, most)
    each = each.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("i") <= F.col("copies") % F.col("n")).cast("long")
    return each.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """The mix itself: every document as often as it is taken, all its columns kept."""
    key = F.xxhash64("doc_id", "source", "size").alias("key")
    rows = docs.select(
        F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")
    )
    rows = rows.select("row", key, "tie")
    rows = rows.select("row", "key", F.row_number().over(Window.partitionBy("key").orderBy("tie")).alias("i"))
    taken = decisions(docs, weights, share, most).select(key, "n", "copies")
    times = F.floor(F.col("copies") / F.col("n")) + (F.col("i") <= F.col("copies") % F.col("n")).cast("long")
    rows = rows.join(taken, "key").select("row", times.alias("times")).filter("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
