"""Sharding by balanced label propagation.

Documents of one text are linked to the first of them, their hub; a group above a quota is
cut into parts with a hub each. Every document starts in a shard by a hash of its number; only
the hubs of large groups, a bounded number, get levelled starts. In each round every document
looks at its neighbours' shards and wants to join most of them; a shard takes as much as its
quota has room for once the documents that leave it are gone, those of large hubs first, and
the rest stay. Documents whose neighbours all rank below them (by number of links) stay where
they are, so that labels spread from hubs. Where a round moves nothing more, hubs whose
neighbours found no room move with them to shards that have it, and rounds go on. Documents
without links then fill what the quotas leave, the large ones first, each band in one ordered
run, which evens out the sizes.

All steps are DataFrame functions on narrow rows; texts are read once, for their sizes and
hashes. Through the driver go sums per pair of shards and the hubs of groups above a fiftieth
of a quota, of which there are at most 50 per shard. Hot hubs meet only in joins that adaptive
execution splits and in sums that combine before the shuffle.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesweave.llm.ordering import in_order
from seriesweave.llm.tables import written

SHARDS = 16
ROUNDS = 6  # at least, as long as anything moves; after these, while a round brings a gain
SLACK = 1.001  # of a quota, where documents change places
RESEEDS = 6  # times that hubs may move; each allows twice the slack of the one before
PART = 0.9  # of a quota: the parts of a group above a quota
BANDS = (0.02, 0.0005)  # of a quota: documents above the first are placed first, and so on


def _unit(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(1 << 40)) / F.lit(float(1 << 40))


def documents_by_text(docs: DataFrame) -> DataFrame:
    """node (position by doc_id, null last), doc_id, size, text_crc32, text_key of docs(doc_id, text, ...).

    A null text is an empty one. size is its UTF-8 bytes plus 1.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.struct(F.xxhash64(data).alias("a"), F.xxhash64(F.lit(1), data, F.length(data)).alias("b")).alias("text_key"),
    )
    return in_order(rows, F.col("doc_id").asc_nulls_last(), F.col("text_key")).withColumnRenamed("position", "node")


def equal_text_groups(nodes: DataFrame, quota: float) -> tuple[DataFrame, DataFrame]:
    """Members (node, size, dst) and hubs (dst, bytes) of the groups of equal texts, cut into parts where above the quota."""
    groups = nodes.groupBy("text_key").agg(F.min("node").alias("dst"), F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    parts = F.when(F.col("bytes") > quota, F.ceil(F.col("bytes") / F.lit(PART * quota))).otherwise(1).cast("long")
    groups = written(groups.select("text_key", "dst", "bytes", parts.alias("parts")), "groups")  # a join of two shuffles can be split where a text is very common
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    members = nodes.select("text_key", "node", "size").join(groups.drop("bytes"), "text_key").withColumn("part", part)
    members = written(members, "members")
    cut = members.filter("parts > 1")
    heads = written(cut.groupBy("text_key", "part").agg(F.min("node").alias("dst"), F.sum("size").alias("bytes")), "heads")
    own = cut.drop("dst").join(heads.drop("bytes"), ["text_key", "part"])
    members = members.filter("parts = 1").select("node", "size", "dst").unionByName(own.select("node", "size", "dst"))
    return members, groups.filter("parts = 1").select("dst", "bytes").unionByName(heads.select("dst", "bytes"))


def started(members: DataFrame, hubs: DataFrame, shards: int, quota: float) -> DataFrame:
    """members with the shard they start in: levelled for hubs of large groups, for all others a hash over the room these leave."""
    large = hubs.filter(F.col("bytes") > BANDS[0] * quota).collect()
    loads, place = [0.0] * shards, []
    for r in sorted(large, key=lambda r: (-r["bytes"], r["dst"])):
        s = min(range(shards), key=lambda s: (loads[s], s))
        loads[s] += r["bytes"]
        place.append((r["dst"], s))
    room = [max(0.0, quota - load) for load in loads]
    if not any(room):
        room = [1.0] * shards
    at = _unit(F.col("node"))
    hashed = reduce(lambda a, b: a + b, [(at >= sum(room[: s + 1]) / sum(room)).cast("int") for s in range(shards - 1)], F.lit(0))
    seeds = F.broadcast(members.sparkSession.createDataFrame(place, "node long, seed int"))  # 50 per shard at most
    return members.join(seeds, "node", "left").select("node", "size", "dst", F.coalesce("seed", hashed).alias("shard"))


def _loads(labels: DataFrame, shards: int, column: str = "size") -> list[float]:
    found = {r["shard"]: float(r["load"]) for r in labels.groupBy("shard").agg(F.sum(column).alias("load")).collect()}
    return [found.get(s, 0.0) for s in range(shards)]


def _table(values: list[float], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), index.cast("int") + 1)


def _taken(wish: DataFrame, flow: list[float], loads: list[float], quota: float) -> DataFrame | None:
    """As many of a shard's wishes, in their order, as its quota has room for when those that leave it are gone."""
    shards = len(loads)
    room = list(flow)
    while True:
        ends = [sum(flow[:s]) + room[s] for s in range(shards)]
        taken = wish.filter(F.col("before_size") + F.col("size") <= _table(ends, F.col("shard")))
        moved = taken.groupBy("from", "shard").agg(F.sum("size").alias("load")).collect()
        out, into = [0.0] * shards, [0.0] * shards
        for r in moved:
            out[r["from"]] += r["load"]
            into[r["shard"]] += r["load"]
        over = [into[s] > 0 and loads[s] + into[s] - out[s] > SLACK * quota for s in range(shards)]
        if not any(over):
            return taken if moved else None
        # Fewer enter, so fewer leave others: again, until all is within the quotas.
        room = [max(0.0, min(into[s] - 1, quota - loads[s] + out[s])) if over[s] else room[s] for s in range(shards)]


def _reseeded(labels: DataFrame, state: DataFrame, both: DataFrame, shards: int, quota: float, slacks: list[float]) -> DataFrame | None:
    """labels after hubs that miss neighbours moved, with these, to shards that have room for all of them.

    Room is what is free when all such hubs and their neighbours are gone; the large come first.
    Uses up slacks, one a try; None where nothing moves.
    """
    hubs = state.filter(~F.col("moves") & (F.col("here") < F.col("degree"))).select(F.col("node").alias("unit"))
    near = both.join(hubs.withColumnRenamed("unit", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("unit"))
    units = near.unionByName(hubs.select(F.col("unit").alias("node"), "unit"))
    units = written(units.join(labels.select("node", "size", "shard"), "node"), "units")
    out, loads = _loads(units, shards), _loads(labels, shards)
    while any(out) and slacks:
        slack = slacks.pop(0)
        room = [max(0.0, slack * quota - load + gone) for load, gone in zip(loads, out)]
        sums = units.groupBy("unit").agg(F.sum("size").alias("size"))
        fits = F.filter(F.transform(F.array(*(F.lit(r) for r in room)), lambda r, s: F.when(r >= F.col("size"), s)), lambda s: s.isNotNull())
        one = F.pmod(F.xxhash64("unit", F.lit(len(slacks))), F.greatest(F.size("fits"), F.lit(1))).cast("int") + 1
        wish = sums.withColumn("fits", fits).select("unit", "size", F.try_element_at("fits", one).alias("to")).filter("to is not null")
        wish = written(in_order(wish, F.col("to"), F.col("size").desc(), F.col("unit"), sums=("size",)), "reseeds")
        flow = _loads(wish.withColumnRenamed("to", "shard"), shards)
        ends = [sum(flow[:s]) + room[s] for s in range(shards)]
        taken = wish.filter(F.col("before_size") + F.col("size") <= _table(ends, F.col("to"))).select("unit", "to")
        if not taken.isEmpty():
            gone = units.join(taken, "unit").select("node", "to")
            return written(labels.join(gone, "node", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "labels")
    return None


def propagate(nodes: DataFrame, links: DataFrame, shards: int, quota: float, rounds: int = ROUNDS) -> DataFrame:
    """node, size, shard, start of the documents that have links; no shard is filled above about its quota.

    Documents start where a column shard of nodes says, or else by hash.
    """
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = written(both, "links")
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    rank = written(degree.select("node", F.struct("degree", (-F.col("node")).alias("first")).alias("rank")), "degrees")
    of = lambda end: rank.select(F.col("node").alias(end), F.col("rank").alias(f"{end}_rank"))
    best = both.join(of("src"), "src").groupBy("dst").agg(F.max("src_rank").alias("best"))
    moving = best.join(of("dst"), "dst").select(F.col("dst").alias("node"), (F.col("best") > F.col("dst_rank")).alias("moves"), F.col("best.degree").alias("hub"))
    start = F.col("shard") if "shard" in nodes.columns else F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    labels = nodes.select("node", "size", start.alias("shard"), start.alias("start")).join(moving, "node")
    labels, most, slacks = written(labels, "labels"), -1, [1 + (SLACK - 1) * 2**k for k in range(RESEEDS)]
    for turn in itertools.count():
        votes = both.join(labels.select(F.col("node").alias("src"), "shard"), "src").groupBy("dst", "shard").agg(F.count("*").alias("votes"))
        ranked = votes.groupBy(F.col("dst").alias("node")).agg(
            F.max(F.struct("votes", (-F.col("shard")).alias("to"))).alias("best"), F.sum("votes").alias("degree"),
            F.map_from_entries(F.collect_list(F.struct("shard", "votes"))).alias("all"),
        )
        here = F.coalesce(F.try_element_at("all", F.col("shard")), F.lit(0))
        state = labels.join(ranked, "node").select("node", "size", "shard", "moves", "hub", "best", "degree", here.alias("here"))
        state, taken = written(state, "votes"), None
        inside = state.agg(F.sum("here")).first()[0] or 0
        if turn < rounds or inside > most:
            most = max(most, inside)
            wish = state.filter("moves").withColumn("to", (-F.col("best.to")).cast("int"))
            wish = wish.filter((F.col("best.votes") > F.col("here")) & (F.col("to") != F.col("shard")))
            if turn > 1:  # two neighbours must not keep changing places
                wish = wish.filter(_unit(F.col("node"), F.lit(turn)) < 0.5)
            wish = wish.select("node", "size", "hub", F.col("shard").alias("from"), F.col("to").alias("shard"))
            wish = in_order(wish, F.col("shard"), F.col("hub").desc(), F.xxhash64(F.lit(turn), "node"), F.col("node"), sums=("size",))
            wish = written(wish, "wishes")
            flow = _loads(wish, shards)
            taken = _taken(wish, flow, _loads(labels, shards), quota) if any(flow) else None
        if taken is not None:
            gone = taken.select("node", F.col("shard").alias("to"))
            labels = written(labels.join(gone, "node", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"), "labels")
            continue
        after = _reseeded(labels, state, both, shards, quota, slacks)
        if after is None:
            return labels.select("node", "size", "shard", "start")
        labels, most = after, -1


def fill(free: DataFrame, loads: list[float], quota: float) -> list[DataFrame]:
    """Place free documents (node, size) so that shards with these loads come out even."""
    shards, placed = len(loads), []
    edges = [float("inf"), *(b * quota for b in BANDS), 0.0]
    for high, low in zip(edges, edges[1:]):
        band = free.filter((F.col("size") <= high) & (F.col("size") > low))
        total = band.agg(F.sum("size")).first()[0]
        if not total:
            continue
        room = [max(0.0, quota - load) for load in loads]
        if not any(room):
            room = [1.0] * shards
        bounds = [total * sum(room[: s + 1]) / sum(room) for s in range(shards - 1)]
        middle = F.col("before_size") + F.col("size") / 2
        shard = reduce(lambda a, b: a + b, [(middle >= b).cast("int") for b in bounds], F.lit(0))
        run = written(in_order(band, F.xxhash64("node"), F.col("node"), sums=("size",)).select("node", "size", shard.alias("shard")), "filled")
        loads = [a + b for a, b in zip(loads, _loads(run, shards))]
        placed.append(run)
    return placed


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, start_shard: equal texts together, sizes of shards near equal.

    A group of copies larger than a quota is split into parts. Slots count from 0 in each shard
    in the order of doc_id, null ids last; repeated rows are documents of their own. start_shard
    is where a document with copies started before propagation, null for the others. Other
    columns of docs are not read. An empty table gives no rows.
    """
    nodes = written(documents_by_text(docs), "nodes")
    total = nodes.agg(F.sum("size")).first()[0] or 0
    quota = total / shards
    members, hubs = equal_text_groups(nodes, quota)
    members = written(started(members, hubs, shards, quota), "started")
    links = members.filter("node <> dst").select(F.col("node").alias("src"), "dst")
    labels = propagate(members.select("node", "size", "shard"), links, shards, quota, rounds)
    free = written(nodes.select("node", "size").join(labels.select("node"), "node", "left_anti"), "free")
    filled = [f.withColumn("start", F.lit(None).cast("int")) for f in fill(free, _loads(labels, shards), quota)]
    every = nodes.join(reduce(DataFrame.unionByName, [labels, *filled]).select("node", "shard", F.col("start").alias("start_shard")), "node")
    every = in_order(every.select("node", "doc_id", "size", "text_crc32", "shard", "start_shard"), F.col("shard"), F.col("node"))
    first = {r["shard"]: r["first"] for r in every.groupBy("shard").agg(F.min("position").alias("first")).collect()}
    start = _table([first.get(s, 0) for s in range(shards)], F.col("shard")).cast("long")
    return every.select("doc_id", "size", "text_crc32", "shard", (F.col("position") - start).alias("slot"), "start_shard")
