"""The prefix trie of conversations, with subtree totals by the Euler-tour technique.

Every distinct sequence of first turns is a node. A prefix is told apart by the 128-bit
exclusive or of its turns' digests, each bound to its depth, so prefixes come out of running
aggregates and not of one hash chain per conversation. The smallest conversation of a node
and its depth name it.

Subtree totals need no pass per level. Each node has an enter and an exit arc, and the arcs
form one list, the Euler tour:

    enter(v) -> enter(first child), or exit(v) for a leaf
    exit(v)  -> enter(next sibling), or exit(parent) for the last one

The list is ranked distributedly. Nodes are numbered in order of (conversation, depth), which
keeps a conversation's own chain and its neighbours together, and cut into blocks. Inside a
block pointer jumping shortens each stretch of the list to one link; the links between blocks
are ranked by pointer jumping over joins, a written table a round. Leaves and savings of a
subtree are the difference of the sums at its enter and exit arcs.

No task holds a whole conversation, a node's members or a node's children: positions are
carried from cell to cell, siblings are linked cell by cell, a node's member list is
written in chunks by sorted ranges and only streamed through its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seriesweave.llm.ordering import in_order
from seriesweave.llm.tables import written
from seriesweave.plans.timeline import Chunking, with_previous

#: Positions and depths per cell, node numbers of siblings per cell, and nodes per block of the tour.
CELL = 1 << 16
SIBLINGS = 1 << 11
BLOCK = 1 << 15
CHUNK = 1 << 17
FAMILY = 5
MOST_SHARED = 8
NODE = ["depth", "a", "b"]


# --- Turns in order, and conversations that share a beginning ----------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0 in its conversation), the turn's two digests a and b, and size, its text's UTF-8 bytes.

    Turns go by number, nulls first, and those of one number by role and text. Null roles and texts are
    empty. Rows without a conv_id belong to no conversation.
    """
    rows = conversations.filter("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    digest = lambda salt: F.xxhash64(F.lit(salt), F.octet_length("role"), "role", "text")
    rows = rows.withColumns({"a": digest(1), "b": digest(2), "size": F.octet_length("text").cast("long"), "_copy": F.monotonically_increasing_id()})
    order = (F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("_copy").asc())
    placed = in_order(rows, *order, leave=("turn", "role", "text", "_copy"))
    # Which conversation begins where is known once per cell, so that a long one meets no single join key.
    ends = placed.groupBy("conv_id").agg(F.min("position").alias("_begin"), F.max("position").alias("_end"))
    cell = lambda c: F.floor(F.col(c) / CELL)
    ends = ends.select("conv_id", "_begin", F.explode(F.sequence(cell("_begin"), cell("_end"))).alias("_cell"))
    placed = placed.withColumn("_cell", cell("position")).join(ends, ["conv_id", "_cell"])
    return placed.select("conv_id", (F.col("position") - F.col("_begin")).alias("place"), "a", "b", "size")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the head of its family: crc32 of its decimal number, modulo 9."""
    return F.crc32(conv_id.cast("string")) % (MOST_SHARED + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """steps (conv_id, depth from 1, a, b, size, length) and convs (conv_id, length) of the rebuilt conversations.

    Conversation c begins with the first h turns of c - c % 5 (rounded down; none if there is no such
    conversation), h being `shared_turns`, and goes on with its own turns after its first h.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    info = own.withColumns({"h": shared_turns(F.col("conv_id")), "head": F.try_subtract("conv_id", F.pmod("conv_id", F.lit(FAMILY)))})
    heads = own.select(F.col("conv_id").alias("head"), F.col("own").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    info = info.join(heads, "head", "left").withColumn("taken", taken)
    info = written(info.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("there"), "convs")

    begun = turns.filter((F.col("place") < MOST_SHARED) & (F.pmod("conv_id", F.lit(FAMILY)) == 0)).withColumnRenamed("conv_id", "head")
    begun = begun.join(info.select("conv_id", "head", "taken", "length"), "head").filter(F.col("place") < F.col("taken"))
    begun = begun.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "size", "length")
    cell = F.floor(F.col("place") / CELL)
    # One row of info for every cell of a conversation's turns.
    cells = info.select("conv_id", "h", "taken", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("own") - 1) / CELL))).alias("_cell"))
    rest = turns.withColumn("_cell", cell).join(cells, ["conv_id", "_cell"]).filter(F.col("place") >= F.col("h"))
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "size", "length")
    return begun.unionByName(rest), info.select("conv_id", "length")


# --- Nodes ------------------------------------------------------------------------


def _prefixes(steps: DataFrame) -> DataFrame:
    """Add to every step the digests of its prefix (a, b) and of the one before it (up_a, up_b)."""
    steps = steps.withColumns({c: F.xxhash64(c, "depth") for c in ("a", "b")}).withColumn("_cell", F.floor(F.col("depth") / CELL))
    so_far = Window.partitionBy("conv_id", "_cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy("conv_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = steps.groupBy("conv_id", "_cell").agg(*(F.bit_xor(c).alias(f"_{c}") for c in ("a", "b")))
    earlier = totals.select("conv_id", "_cell", *(F.bit_xor(f"_{c}").over(along).alias(f"_from_{c}") for c in ("a", "b"))).filter("_from_a is not null")
    steps = steps.repartition("conv_id", "_cell").withColumns({f"_in_{c}": F.bit_xor(c).over(so_far) for c in ("a", "b")})
    steps = steps.join(earlier, ["conv_id", "_cell"], "left")
    whole = {c: F.col(f"_in_{c}").bitwiseXOR(F.coalesce(f"_from_{c}", F.lit(0))) for c in ("a", "b")}
    return steps.select(
        "conv_id", "depth", "size", "length", *(w.alias(c) for c, w in whole.items()), *(w.bitwiseXOR(F.col(c)).alias(f"up_{c}") for c, w in whole.items())
    )


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes with their number `node`, in order of (conv_id, depth), and their parent's, `parent` and parent_conv_id."""
    found = prefixes.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b")
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.withColumns({"depth": zero, "a": zero, "b": zero, "size": zero, "up_a": F.lit(None).cast("long"), "up_b": F.lit(None).cast("long")})
    nodes = in_order(found.unionByName(root), F.col("conv_id").asc(), F.col("depth").asc()).withColumnRenamed("position", "node")
    nodes = written(nodes, "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return written(nodes.join(above, ["depth", "up_a", "up_b"], "left").drop("up_a", "up_b"), "nodes")


def _members(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """ends_sha256 of every node at which conversations end."""
    schema = "depth long, a long, b long, first long, chunk string"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of one node's members as comma-joined texts; rows come sorted."""
        for batch in batches:
            depth, a, b, conv_id = (batch.column(i).to_numpy() for i in range(4))
            if not len(depth):
                continue
            cut = (np.diff(depth) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
            starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
            starts = np.unique(np.concatenate([starts, np.arange(0, len(depth), CHUNK)]))
            ids = [str(x) for x in conv_id.tolist()]
            texts = [",".join(ids[x:y]) for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(c[starts]) for c in (depth, a, b, conv_id)] + [pa.array(texts)], schema=types)

    said = "depth long, a long, b long, ends_sha256 string"
    told = to_arrow_schema(StructType.fromDDL(said))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for i, key in enumerate(keys):
                text = batch.column(4)[i].as_py().encode()
                if key == now:
                    digest.update(b"," + text)
                else:
                    if now:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), told.types)], schema=told)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, digest.hexdigest()), told.types)], schema=told)

    zero = F.lit(0).cast("long")
    ends = prefixes.filter(F.col("depth") == F.col("length")).select(*NODE, "conv_id")
    ends = ends.unionByName(convs.filter("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    ends = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = ends.mapInArrow(chunks, schema)
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "first", "chunk").mapInArrow(digests, said)


# --- The tour ---------------------------------------------------------------------


def _tour(nodes: DataFrame) -> DataFrame:
    """node, its n_children, and next_in and next_out, the arcs after its enter arc 2 * node and its exit arc 2 * node + 1 (-1: none)."""
    below = nodes.filter("parent is not null").select("node", "parent").withColumn("_back", -F.col("node"))
    below = with_previous(below, ["parent"], ["_back"], {"_next": F.struct("node")}, chunking=Chunking(SIBLINGS))
    last = F.col("parent") * 2 + 1
    sideways = below.select("node", F.coalesce(F.col("_next.node") * 2, last).alias("next_out"))
    children = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.min(F.col("_back") * -1).alias("_first"))
    tour = nodes.select("node", "n_convs", "size").join(sideways, "node", "left").join(children, "node", "left")
    return tour.select(
        "node",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce(F.col("_first") * 2, F.col("node") * 2 + 1).alias("next_in"),
        F.coalesce("next_out", F.lit(-1)).alias("next_out"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )


def _shorten(block: pd.DataFrame) -> pd.DataFrame:
    """For each arc of a block: the first arc after it in another block, and the sums on the way there, its own included."""
    block = block.sort_values("node")
    nodes = block["node"].to_numpy(np.int64)
    arcs = np.empty(2 * len(nodes), np.int64)
    arcs[::2], arcs[1::2] = 2 * nodes, 2 * nodes + 1
    out = np.empty_like(arcs)
    out[::2], out[1::2] = block["next_in"], block["next_out"]
    sums = np.zeros((len(arcs), 3), np.int64)
    sums[:, 0] = 1
    sums[::2, 1] = block["n_children"] == 0
    sums[::2, 2] = block["saved"]
    at = np.minimum(np.searchsorted(arcs, out), len(arcs) - 1)
    inside = arcs[at] == out
    begins = np.ones(len(arcs), bool)
    begins[at[inside]] = False
    at = np.where(inside, at, -1)
    while (at >= 0).any():
        # Every pointer doubles its reach; sums go along.
        on = np.flatnonzero(at >= 0)
        to = at[on]
        sums[on] += sums[to]
        out[on] = out[to]
        at[on] = at[to]
    return pd.DataFrame({
        "node": nodes, "out_in": out[::2], "n_in": sums[::2, 0], "leaves_in": sums[::2, 1], "saved_in": sums[::2, 2], "begins_in": begins[::2],
        "out_out": out[1::2], "n_out": sums[1::2, 0], "leaves_out": sums[1::2, 1], "saved_out": sums[1::2, 2], "begins_out": begins[1::2],
    })


SHORT = ", ".join(["node long"] + [f"out_{s} long, n_{s} long, leaves_{s} long, saved_{s} long, begins_{s} boolean" for s in ("in", "out")])
SUMS = ("n", "leaves", "saved")


def _ranked(links: DataFrame) -> DataFrame:
    """Sums from each arc to the end of the list; links(arc, out, n, leaves, saved), out is -1 at the end.

    No two links point at one arc, so the joins meet no common key.
    """
    links = written(links, "links")
    while not links.filter("out >= 0").isEmpty():
        after = links.select(F.col("arc").alias("out"), F.col("out").alias("_out"), *(F.col(c).alias(f"_{c}") for c in SUMS))
        going = links.filter("out >= 0").join(after, "out")
        going = going.select("arc", F.col("_out").alias("out"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in SUMS))
        links = written(links.filter("out < 0").unionByName(going), "links")
    return links


def _subtrees(tour: DataFrame) -> DataFrame:
    """node with n_leaves, saved_tokens and the places of its arcs in the tour, enter and exit."""
    short = tour.withColumn("_block", F.floor(F.col("node") / BLOCK)).groupBy("_block").applyInPandas(_shorten, SHORT)
    short = written(short, "short")
    begins = [
        short.filter(f"begins_{s}").select((F.col("node") * 2 + k).alias("arc"), F.col(f"out_{s}").alias("out"), *(F.col(f"{c}_{s}").alias(c) for c in SUMS))
        for k, s in enumerate(("in", "out"))
    ]
    ranked = _ranked(begins[0].unionByName(begins[1]))
    for s in ("in", "out"):
        far = ranked.select(F.col("arc").alias(f"out_{s}"), *(F.col(c).alias(f"_{c}_{s}") for c in SUMS))
        short = short.join(far, f"out_{s}", "left")
        short = short.withColumns({f"{c}_{s}": F.col(f"{c}_{s}") + F.coalesce(f"_{c}_{s}", F.lit(0)) for c in SUMS})
    arcs = 2 * tour.count()  # an arc's place is the number of arcs that it has not got behind it
    return short.select(
        "node",
        (F.col("leaves_in") - F.col("leaves_out")).alias("n_leaves"),
        (F.col("saved_in") - F.col("saved_out")).alias("saved_tokens"),
        *((F.lit(arcs) - F.col(f"n_{s}")).alias(n) for s, n in (("in", "enter"), ("out", "exit"))),
    )


def trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of steps(conv_id, depth, a, b, size, length) and convs(conv_id, length), one row each.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and enter and exit, the places of its arcs in the Euler tour. Equal conversations
    are members of the same nodes. Without conversations there are no nodes.
    """
    prefixes = written(_prefixes(steps), "prefixes")
    nodes = _nodes(prefixes, convs)
    tour = written(_tour(nodes), "tour")
    out = nodes.join(tour.select("node", "n_children"), "node").join(_subtrees(tour), "node").join(_members(prefixes, convs), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "enter", "exit",
    )


def family_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the `rebuilt` conversations(conv_id, turn, role, text); further columns are ignored."""
    steps, convs = rebuilt(written(ordered_turns(conversations), "turns"))
    return trie(steps, convs)
