"""Near-duplicate documents: SetSketch bands, likelihood estimates, exact confirmation.

Documents with one set of shingles are a class, sketched once. Classes that share a band of
registers are candidates. In each bucket of a band one representative of every component
found so far, the class that meets most others, meets the main one of them, so a bucket of n
classes gives n pairs, not n^2; after ROUNDS rounds, what is still apart in a bucket is
compared in blocks, by registers, and those classes that may have a link in their block once
more by full sets, emitting only links, each from the first band that its ends share. Pairs
whose most likely similarity is far below the threshold are left out (5 standard
deviations); all others are confirmed on full sets. Links go through connected components.

Texts are read again for full sets. A bitmap of at most BITS bits, whatever the input, tells
most rows that are not wanted before the rest is shuffled: texts, classes that meet no other,
bands that one class has. Joins of sets and registers are shuffled at every size, so that disk
grows as the input does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesweave.llm.components import components
from seriesweave.llm.setsketch import REGISTERS, bands, digests, likely_similarity, registers, shingle_sets
from seriesweave.llm.tables import small_batches, written
from seriesweave.llm.tokens import release
from seriesweave.llm.words import tidy

ROUNDS = 2
BLOCK = 1024
BATCH_BYTES = 4 << 20  # of texts, registers or sets handed to Python at once
BITS = 1 << 25  # of the bitmap of wanted rows: 4 MB


def _sketch(size: int):
    names = ["doc_id", "text_key", "n", "node", "registers"]

    @tidy
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in tables:
            doc_ids, texts, keys = table.column(0), table.column(1).to_pylist(), table.column(2)
            for a, hashes, ends in shingle_sets(texts, size):
                first, second = digests(hashes, ends)
                n = np.diff(ends)
                node = ((first ^ (second << np.uint64(1))) + n.astype(np.uint64)).view(np.int64)
                rows = registers(hashes, ends)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * REGISTERS), len(n), [None, pa.py_buffer(rows.tobytes())])
                columns = [doc_ids.slice(a, len(n)), keys.slice(a, len(n)), pa.array(n), pa.array(node), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


@tidy
def _bands(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        keys = bands(_rows(table.column(1))) if table.num_rows else np.zeros((0, 1), np.uint64)
        nodes = np.repeat(table.column(0).to_numpy(), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], names=["bucket", "node"])


def _likely(least: float):
    """Keep pairs (a, b, n_a, n_b, r_a, r_b) whose most likely similarity is at least `least`."""

    @tidy
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            if table.num_rows:
                n_a, n_b = (table.column(i).to_numpy().astype(np.float64) for i in (2, 3))
                keep = likely_similarity(_rows(table.column(4)), _rows(table.column(5)), n_a, n_b) >= least
                yield table.select([0, 1]).filter(pa.array(keep))

    return run


def _sets(size: int):
    """node and set of those texts that are of that class."""

    @tidy
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table in tables:
            nodes, texts = table.column(0).to_pylist(), table.column(1).to_pylist()
            for a, hashes, ends in shingle_sets(texts, size):
                first, second = digests(hashes, ends)
                n = np.diff(ends)
                node = ((first ^ (second << np.uint64(1))) + n.astype(np.uint64)).view(np.int64).tolist()
                own = [i for i, x in enumerate(node) if x == nodes[a + i]]
                rows = [(node[i], hashes[ends[i] : ends[i + 1]].tobytes()) for i in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary()))], names=["node", "set"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    @tidy
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            keep = []
            for x, y in zip(table.column(2), table.column(3)):
                keep.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield table.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _meeting(key: tuple, table: pa.Table, percent: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Row i and rows j of one block (or two) that are likely similar to it, in another component and first meet in this bucket."""
    n, part, component = (table[c].to_numpy() for c in ("n", "part", "component"))
    rows = _rows(table["registers"].combine_chunks())
    keys, own = bands(rows), key[0].as_py() % 2**64
    for i in range(len(n)):
        other = (component != component[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        other &= (np.arange(len(n)) > i) if key[1] == key[2] else (part > part[i])
        j = np.flatnonzero(other)
        if len(j):
            shared = keys[j] == keys[i]
            j = j[keys[j, shared.argmax(axis=1)] == np.uint64(own)]
            likely = likely_similarity(np.broadcast_to(rows[i], rows[j].shape), rows[j], np.full(len(j), n[i], float), n[j].astype(float))
            yield i, j[likely >= least]


HOPEFUL = "bucket long, low int, high int, part int, node long, n long, component long"


def _hopeful(percent: int, least: float):
    """Rows of a block that may have a link in it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keep = np.zeros(table.num_rows, dtype=bool)
        for i, j in _meeting(key, table, percent, least):
            keep[j] = True
            keep[i] |= len(j) > 0
        return table.select([c.split()[0] for c in HOPEFUL.split(", ")]).filter(pa.array(keep))

    return run


def _compare(percent: int, least: float):
    """Similar pairs of one block (or two) that are in different components, by full sets where likely."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]]
        a, b = [], []
        for i, j in _meeting(key, table, percent, least):
            j = np.array([k for k in j.tolist() if _similar(sets[i], sets[k], percent)], dtype=np.int64)
            a.extend(np.minimum(node[i], node[j]).tolist())
            b.extend(np.maximum(node[i], node[j]).tolist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _text_key(docs: DataFrame) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(docs["text"]).alias("text_key")


def _maybe(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key, a hash, is among those of wanted, and a few others. Rows are not shuffled."""
    at = F.pmod(key, F.lit(BITS))
    part, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    bits = wanted.select(part.alias("_part"), bit.alias("_bit")).repartition("_part")
    bits = bits.groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    met = rows.withColumns({"_part": part, "_bit": bit}).join(F.broadcast(bits), "_part")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)


class _Search:
    def __init__(self, docs: DataFrame, size: int, percent: int):
        small_batches(docs.sparkSession, BATCH_BYTES)
        self.docs, self.size, self.percent = docs, size, percent
        self.least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
        kind = "doc_id long, text_key long, n long, node long, registers binary"
        sketches = docs.select("doc_id", "text", _text_key(docs)).mapInArrow(_sketch(size), kind)
        self.sketches = written(sketches.withColumn("row", F.monotonically_increasing_id()), "sketches")
        # Only numbers are aggregated, in hash tables; registers and the spot, which finds a text again, come from one row of each class.
        longs = self.sketches.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("row").alias("row"))
        of_row = self.sketches.select("row", "registers", F.xxhash64("doc_id", "text_key").alias("spot"))
        self.classes = written(written(longs, "longs").join(of_row, "row").drop("row"), "classes")
        keyed = self.classes.select("node", "registers").mapInArrow(_bands, "bucket long, node long")
        shared = keyed.groupBy("bucket").agg(F.count("*").alias("classes")).filter("classes > 1")
        # Written, as are other sums that rows of hot keys are joined to: a join of two shuffles can be split.
        shared = written(shared, "shared")
        buckets = written(_maybe(keyed, shared, "bucket").join(shared, "bucket"), "buckets")
        # How many classes a class meets: the original of a group of copies meets the most.
        met = written(buckets.groupBy("node").agg(F.sum("classes").alias("met")), "met")
        self.buckets = written(buckets.join(met, "node"), "buckets")
        self.meeting = written(_maybe(self.classes.select("node", "n", "registers", "spot"), met, "node"), "meeting")
        self.labels = None  # node, component of linked classes

    def labelled(self) -> DataFrame:
        if self.labels is None:
            return self.buckets.withColumn("component", F.col("node"))
        of = self.buckets.join(self.labels, "node", "left")
        return of.withColumn("component", F.coalesce("component", "node"))

    def round(self, turn: int) -> DataFrame:
        """One candidate for every component but one in every bucket."""
        rows = self.labelled()
        by = F.struct((-F.col("met")).alias("by"), F.xxhash64(F.lit(turn), "node").alias("then"), F.col("node"), F.col("component"))
        each = rows.groupBy("bucket", "component").agg(F.min(by).alias("one")) if turn else rows.select("bucket", "component", by.alias("one"))
        main = each.groupBy("bucket").agg(F.min("one").alias("main"), F.count("*").alias("parts")).filter("parts > 1")
        main = written(main, "main")
        pairs = each.join(main, "bucket").filter(F.col("one.component") != F.col("main.component"))
        a, b = F.col("one.node"), F.col("main.node")
        return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    def likely(self, pairs: DataFrame) -> DataFrame:
        of = lambda end: self.meeting.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("registers").alias(f"r_{end}"))
        met = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
        met = met.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        return met.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_likely(self.least), "a long, b long")

    def apart(self) -> DataFrame:
        """Links between classes that share a bucket and are in different components yet."""
        rows = self.labelled()
        mixed = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
        mixed = written(mixed, "mixed")
        parts = F.ceil(F.col("classes") / BLOCK).cast("int")
        rows = written(rows.drop("met").join(mixed, "bucket"), "rows")
        registers = self.meeting.select("node", "n", "registers")
        rows = rows.join(registers.hint("merge"), "node")
        rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
        # Blocks cost time by their pairs, not their bytes: Spark is not to join them by size.
        block, partitions = ("bucket", "low", "high"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hopeful = rows.repartition(partitions, *block).groupBy(*block).applyInArrow(_hopeful(self.percent, self.least), HOPEFUL)
        # Sets are many times as long as registers, and a class lies in many buckets.
        hopeful = written(hopeful, "hopeful")
        full = self.sets(hopeful.select("node").distinct()).join(registers.drop("n").hint("merge"), "node")
        rows = hopeful.join(full.hint("merge"), "node")
        found = rows.repartition(partitions, *block).groupBy(*block).applyInArrow(_compare(self.percent, self.least), "a long, b long")
        return written(found.distinct(), "confirmed")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar by their full sets."""
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        sets = self.sets(nodes)
        of = lambda end: sets.select(F.col("node").alias(end), F.col("set").alias(f"s_{end}"))
        met = pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").select("a", "b", "s_a", "s_b")
        return written(met.mapInArrow(_confirm(self.percent), "a long, b long"), "confirmed")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node and set of classes, from the text of one member each."""
        reps = written(nodes.join(self.meeting.select("node", "spot"), "node"), "involved")
        # Rows that repeat an id and its text meet here, before sets are made.
        texts = self.wanted(reps).join(reps.hint("merge"), "spot").distinct().select("node", "text")
        return written(texts.mapInArrow(_sets(self.size), "node long, set binary"), "sets")

    def wanted(self, reps: DataFrame) -> DataFrame:
        """spot and text of the rows that reps(spot, ...) need, and of few others."""
        return _maybe(self.docs.select(F.xxhash64("doc_id", _text_key(self.docs)).alias("spot"), "text"), reps, "spot")

    def link(self, links: DataFrame) -> None:
        """Join the components that links connect."""
        if self.labels is None:
            self.labels = components(links)
            return
        old = self.labels.select("node", F.col("component").alias("to"))
        name = lambda end: F.coalesce(f"{end}_to", end)
        edges = links
        for end in ("a", "b"):
            edges = edges.join(old.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end, "left")
        found = components(edges.select(name("a").alias("a"), name("b").alias("b")).filter("a <> b"))
        known = self.labels.select("node", F.col("component").alias("old")).join(found.select(F.col("node").alias("old"), F.col("component").alias("new")), "old", "left")
        known = known.select("node", F.coalesce("new", "old").alias("component"))
        fresh = found.join(self.labels, "node", "left_anti")
        self.labels = written(known.unionByName(fresh), "labels")

    def run(self) -> DataFrame:
        for turn in range(ROUNDS):
            links = self.confirm(written(self.likely(self.round(turn)), "likely"))
            if links.isEmpty():
                break
            self.link(links)
        links = self.apart()
        if not links.isEmpty():
            self.link(links)
        linked = self.classes.select("node", "rep")
        if self.labels is not None:
            named = linked.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            first = written(named.groupBy("component").agg(F.min("rep").alias("first")), "first")
            linked = named.join(first, "component").select("node", F.col("first").alias("rep"))
        linked = written(linked, "linked")
        rows = self.sketches.select("doc_id", "text_key", "n", "node")
        full = rows.filter("n > 0").join(linked, "node").select("doc_id", "text_key", "n", F.col("rep").alias("component_id"))
        out = full.unionByName(rows.filter("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id")))
        kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
        return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text, ...).

    Words are runs without ASCII white space, A-Z in lower case. Documents are linked where
    100 * intersection >= percent * union of their sets of `size`-word shingles; a component's
    id is its smallest doc_id, and the documents with that id are kept. A text without words,
    or null, has an empty set and no links. Rows that repeat an id are rows of their own and
    are kept together; null ids are linked, but never name a component that has others.
    """
    return _Search(docs.select("doc_id", "text"), size, percent).run().drop("text_key")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the document with the smallest doc_id of each component, all columns kept.

    Rows without an id stay. A row goes by its id and text: of rows that repeat an id, those
    stay whose own component has that id. Of rows that agree in id and text one stays.
    """
    found = _Search(docs.select("doc_id", "text"), size, percent).run().filter("doc_id is not null")
    keys = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.first("kept").alias("stays"), F.count("*").alias("times"))
    keys = written(keys.filter("not stays or times > 1"), "keys")

    def of(some: DataFrame) -> tuple[DataFrame, Column]:
        some = some.select("_id", "_key")
        return some, (docs["doc_id"] == some["_id"]) & (_text_key(docs) == some["_key"])

    again = keys.filter("stays")
    if again.isEmpty():
        return docs.join(*of(keys), "left_anti")
    # Only repeated rows are shuffled with their texts.
    repeated = docs.join(*of(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(*of(keys), "left_anti").unionByName(repeated)
