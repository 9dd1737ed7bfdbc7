"""Exact top-k by inner product: dual-tree search over cover trees.

Vectors are dealt to blocks by their nearest pivot (a bounded sample), large pivots split
by hash. Every block of data and every block of queries becomes a cover tree: balls of
halving radius, down to leaves of at most LEAF vectors. Two nodes bound all their inner
products by <c, d> + |c| s + |d| r + r s (centres c, d and radii r, s), so a pair of nodes
whose bound is below the worst kth score of the queries in one of them is skipped.

A query block first meets the block of data with the best bound; its kth scores then rule
out whole blocks by their roots, before the rest are joined. Every query's best rows of
each pair of blocks (k at most) meet in one window per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesweave.llm.tables import written

DATA_BLOCK = 4096
QUERY_BLOCK = 256
MOST_PIVOTS = 1024
LEAF = 128
GROUPS = 8  # parts that blocks of data are dealt to when pairs of blocks are bounded
NONE = np.iinfo(np.int64).min + 1  # its negative is a number too
SLACK = 1e-6  # relative, against rounding of radii and norms


@dataclass
class Tree:
    """Cover tree nodes in numpy: children of a node follow each other; leaves hold rows."""

    vectors: np.ndarray  # in the order of leaves
    ids: np.ndarray
    rows: np.ndarray  # numbers that tell rows of one id apart
    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    start: np.ndarray  # rows of a node
    stop: np.ndarray
    children: list[list[int]]

    @staticmethod
    def build(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> Tree:
        numbers = ids if rows is None else rows
        order, centres, radii, starts, stops, children = np.arange(len(ids)), [], [], [], [], []

        def node(rows: np.ndarray, start: int) -> int:
            points = vectors[rows]
            centre = points.mean(axis=0)
            distance = np.sqrt(((points - centre) ** 2).sum(axis=1))
            number = len(centres)
            centres.append(centre)
            radii.append(distance.max())
            starts.append(start)
            stops.append(start + len(rows))
            children.append([])
            order[start : start + len(rows)] = rows
            if len(rows) > LEAF and radii[-1] > 0:
                # A net: centres more than half the radius apart, every row with its nearest.
                pick, near = int(distance.argmax()), np.full(len(rows), np.inf)
                owner, count = np.zeros(len(rows), dtype=np.int64), 0
                while near.max() > radii[number] / 2 and count < 16:
                    d = np.sqrt(((points - points[pick]) ** 2).sum(axis=1))
                    owner[d < near] = count
                    near, count = np.minimum(near, d), count + 1
                    pick = int(near.argmax())
                groups = [rows[owner == g] for g in range(count)]
                groups = [g for g in groups if len(g)]
                if len(groups) > 1:
                    for group in groups:
                        children[number].append(node(group, start))
                        start += len(group)
            return number

        node(np.arange(len(ids)), 0)
        centre = np.array(centres)
        return Tree(
            vectors[order], ids[order], numbers[order], centre, np.sqrt((centre**2).sum(axis=1)), np.array(radii) * (1 + SLACK),
            np.array(starts), np.array(stops), children,
        )


def bound(a: Tree, i: int, b: Tree, j: int | np.ndarray) -> np.ndarray:
    """No inner product of rows below both nodes is larger."""
    value = b.centre[j] @ a.centre[i] + a.norm[i] * b.radius[j] + b.norm[j] * a.radius[i] + a.radius[i] * b.radius[j]
    return value + SLACK * (1 + np.abs(value))


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.scores, self.ids = k, np.full((queries, k), NONE), np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor  # kth scores known beforehand

    def worst(self, rows: slice) -> int:
        return int(np.maximum(self.scores[rows, -1], self.floor[rows]).min())

    def add(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        better = scores.max(axis=1) >= np.maximum(self.scores[rows, -1], self.floor[rows])
        if not better.any():
            return
        rows, scores = np.arange(rows.start, rows.stop)[better], scores[better]
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(scores), len(ids)))], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(queries: Tree, data: Tree, best: Best) -> None:
    """Dual-tree search: pairs of nodes by falling bound, skipped below the query node's worst kth score."""
    exact = np.abs(queries.vectors).max() * np.abs(data.vectors).max() * data.vectors.shape[1] >= 2**52
    pending = [(0, 0, float(bound(queries, 0, data, 0)))]
    while pending:
        q, d, most = pending.pop()
        rows = slice(queries.start[q], queries.stop[q])
        if most < best.worst(rows):
            continue
        split_query = queries.children[q] and (not data.children[d] or queries.radius[q] > data.radius[d])
        if split_query:
            pairs = [(c, d, float(bound(queries, c, data, d))) for c in queries.children[q]]
        elif data.children[d]:
            pairs = [(q, c, m) for c, m in zip(data.children[d], bound(queries, q, data, np.array(data.children[d])).tolist())]
        else:
            own = slice(data.start[d], data.stop[d])
            a, b = queries.vectors[rows], data.vectors[own]
            if exact:  # 64-bit integers; floating point is as exact, and faster, below 2**53
                scores = a.astype(np.int64) @ b.astype(np.int64).T
            else:
                scores = (a @ b.T).astype(np.int64)
            scores[queries.rows[rows, None] == data.rows[own]] = NONE
            best.add(rows, scores, data.ids[own])
            continue
        pending.extend(sorted(pairs, key=lambda p: p[2]))


def quantized(vector: Column) -> Column:
    """floor(256 x) of every component as long; null for a vector that is null, empty or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(x) > 0), F.transform(x, lambda v: F.floor(v * 256)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def _pivot(pivots: np.ndarray):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            v = _matrix(table.column(1)) if table.num_rows else np.zeros((0, pivots.shape[1]))
            near = ((pivots**2).sum(axis=1) - 2 * (v @ pivots.T)).argmin(axis=1) if len(v) else np.zeros(0, np.int64)
            yield table.append_column("pivot", pa.array(near.astype(np.int32)))

    return run


def _tree_of(ids: bytes, rows: bytes, vectors: bytes) -> Tree:
    ids, rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
    return Tree.build(np.frombuffer(vectors[1:], f"<i{vectors[0]}").reshape(len(ids), -1).astype(np.float64), ids, rows)


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a block: its rows in order, and the ball around them."""
    order = np.argsort(rows["row"].to_numpy())
    ids, numbers, v = rows["vec_id"].to_numpy()[order], rows["row"].to_numpy()[order], _matrix(rows["v"])[order]
    centre = v.mean(axis=0)
    radius = np.sqrt(((v - centre) ** 2).sum(axis=1)).max() * (1 + SLACK)
    width = 2 if np.abs(v).max() < 2**15 else 8
    return pa.table({
        "block": [key[0].as_py()], "n": [len(ids)], "centre": [centre.tolist()], "norm": [float(np.sqrt((centre**2).sum()))], "radius": [float(radius)],
        "ids": [ids.tobytes()], "rows": [numbers.tobytes()], "vectors": [bytes([width]) + v.astype(f"<i{width}").tobytes()],
    }, schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("norm", pa.float64()), ("radius", pa.float64()),
                         ("ids", pa.binary()), ("rows", pa.binary()), ("vectors", pa.binary())]))


BLOCK = "block long, n long, centre array<double>, norm double, radius double, ids binary, rows binary, vectors binary"
FOUND = "q_block long, query_row long, query_id long, vec_id long, score long"


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (vec_id, v, pivot, row) in blocks of about `size`, large pivots split by a hash of the row."""
    pieces = rows.groupBy("pivot").agg(F.ceil(F.count("*") / size).alias("pieces"))
    dealt = rows.join(F.broadcast(pieces), "pivot")  # one row per pivot, MOST_PIVOTS at most
    block = F.col("pivot") * F.lit(1 << 32) + F.pmod(F.xxhash64("row"), F.col("pieces"))
    blocks = dealt.select("vec_id", "row", "v", block.alias("block")).groupBy("block").applyInArrow(_block, BLOCK)
    return written(blocks.select(*(F.col(c).alias(f"{name}_{c}") for c in blocks.columns)), name)


def _search(k: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, data = None, None
        for table in tables:
            for row in table.to_pylist():
                if held != row["d_block"]:
                    held, data = row["d_block"], _tree_of(row["d_ids"], row["d_rows"], row["d_vectors"])
                queries = _tree_of(row["q_ids"], row["q_rows"], row["q_vectors"])
                known = dict(row["floors"] or ())
                floor = np.array([known.get(i, NONE) for i in queries.rows.tolist()], dtype=np.int64)
                best = Best(len(queries.ids), k, floor)
                search(queries, data, best)
                q, j = np.nonzero((best.scores > NONE) & (best.scores >= floor[:, None]))
                columns = [np.full(len(q), row["q_block"]), queries.rows[q], queries.ids[q], best.ids[q, j], best.scores[q, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q_block", "query_row", "query_id", "vec_id", "score"])

    return run


def _pairs(queries: DataFrame, data: DataFrame) -> DataFrame:
    """q_block, d_block, most: every block of queries with every block of data, and the bound of their roots."""
    q = queries.select("q_block", "q_centre", "q_norm", "q_radius", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("group"))
    d = data.select("d_block", "d_centre", "d_norm", "d_radius", F.pmod(F.xxhash64("d_block"), F.lit(GROUPS)).cast("int").alias("group"))
    dot = F.aggregate(F.zip_with("q_centre", "d_centre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    most = dot + F.col("q_norm") * F.col("d_radius") + F.col("d_norm") * F.col("q_radius") + F.col("q_radius") * F.col("d_radius")
    pairs = q.join(d, "group").select("q_block", "d_block", most.alias("most"))
    return pairs.withColumn("most", F.col("most") + SLACK * (1 + F.abs("most")))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query in vectors(vec_id, embedding, ...).

    Queries are the rows whose id is divisible by `every`. Vectors that are null, empty or
    hold null or non-finite components take no part, nor do null ids. Rows that repeat an id are
    rows of their own: as candidates of each other, and as queries with k results each. Vectors have the most common length; others cannot
    be multiplied with them and take no part. Ties go to the smaller id.
    """
    rows = vectors.select("vec_id", quantized(F.col("embedding")).alias("v")).filter("vec_id is not null and v is not null")
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows, count = rows.filter(F.size("v") == sizes["size"]), sizes["n"]
    wanted = min(MOST_PIVOTS, max(1, -(-count // data_block)))
    share = int(min(1.0, 4 * wanted / count) * (1 << 40))
    near = rows.filter(F.pmod(F.xxhash64(F.lit(7), "vec_id", "v"), F.lit(1 << 40)) <= share)
    sample = near.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(wanted).collect()
    pivots = np.array([r["v"] for r in sample or [rows.first()]], dtype=np.float64)
    dealt = rows.mapInArrow(_pivot(pivots), "vec_id long, v array<long>, pivot int")
    dealt = written(dealt.withColumn("row", F.monotonically_increasing_id()), "vectors")
    data = _blocks(dealt, data_block, "d")
    queries = _blocks(dealt.filter(F.col("vec_id") % every == 0), query_block, "q")
    pairs = written(_pairs(queries, data), "pairs")
    find = _search(k)
    asked = queries.select("q_block", "q_n", "q_ids", "q_rows", "q_vectors")
    held = data.select("d_block", "d_ids", "d_rows", "d_vectors")

    first = pairs.groupBy("q_block").agg(F.max(F.struct("most", "d_block")).alias("best")).select("q_block", "best.d_block")
    met = first.join(asked, "q_block").withColumn("floors", F.lit(None).cast("map<bigint,bigint>"))
    found = written(met.join(held, "d_block").mapInArrow(find, FOUND), "first")

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
    floors = kth.groupBy("q_block").agg(
        F.map_from_entries(F.collect_list(F.struct("query_row", "score"))).alias("floors"), F.min("score").alias("least"), F.count("*").alias("known")
    )
    rest = pairs.join(first, ["q_block", "d_block"], "left_anti").join(asked, "q_block").join(floors, "q_block", "left")
    rest = rest.filter(F.col("least").isNull() | (F.col("known") < F.col("q_n")) | (F.col("most") >= F.col("least")))
    more = rest.select("d_block", "q_block", "q_ids", "q_rows", "q_vectors", "floors").join(held, "d_block").mapInArrow(find, FOUND)
    ranked = found.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
