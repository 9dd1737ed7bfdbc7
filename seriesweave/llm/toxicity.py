"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Features of a text are its words of letters (A-Z in lower case) and their first four and
five bytes, so that inflected and compounded insults meet; each counts anew when it occurs
twice and four times, as some insults are also ordinary words. From a bounded sample of labelled
rows (EXAMPLES, near copies once) come the features that mark toxic texts, at most
VOCABULARY, and the examples; document frequencies are counted over all documents.

Scoring finds a text's NEIGHBOURS nearest examples exactly, by a block-max inverted index:
examples are cut into blocks, every feature keeps its largest weight per block, and blocks
are visited by falling upper bound until none can hold a nearer example. Neighbours vote
with the square of their cosine, against a fixed weight of the share of toxic examples
among those without any feature; texts without features get that share. The index is
bounded by the two limits and is broadcast; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesweave.llm.tables import small_batches, written
from seriesweave.llm.tokens import release
from seriesweave.llm.words import NO_LETTER, batches, mix, tidy, words

EXAMPLES = 10_000
VOCABULARY = 4096
LEAST_TOXIC = 5
LEVELS = (1, 2, 4)
PRECISION, SIGMAS = 0.4, 3.0  # a feature's share of toxic examples must surely be above
NEIGHBOURS = 15
PRIOR_WEIGHT = 2.0
BLOCK = 128
BATCH_BYTES = 4 << 20  # of texts handed to Python at once
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _features(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text numbers, feature hashes), a hash for every occurrence."""
    for a, b in batches(texts):
        w = words(texts[a:b], between=NO_LETTER)
        text = np.repeat(np.arange(a, b), np.diff(w.first))
        length = w.ends - w.starts
        parts = [(text, w.hashes(w.starts, w.ends))]
        for n in (4, 5):
            longer = length > n
            parts.append((text[longer], w.hashes(w.starts[longer], w.starts[longer] + n)))
        yield a, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _counted(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) in order, and how often each occurs."""
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(feature) != 0)])) if len(text) else np.zeros(0, int)
    return text[first], feature[first], np.diff(np.append(first, len(text)))


@tidy
def _sketch(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic, text and two minima over hashes of word pairs, alike for near copies."""
    for table in tables:
        texts = table.column(2).to_pylist()
        keys = np.zeros((len(texts), 2), dtype=np.int64)
        for a, b in batches(texts):
            w = words(texts[a:b])
            h = w.hashes(w.starts, w.ends)
            for i, (first, last) in enumerate(zip(w.first[:-1], w.first[1:])):
                pairs = mix(h[first : last - 1] * np.uint64(3) + h[first + 1 : last]) if last - first > 1 else h[first:last]
                if len(pairs):
                    keys[a + i] = pairs.min() >> np.uint64(1), mix(pairs + np.uint64(1)).min() >> np.uint64(1)
        yield pa.RecordBatch.from_arrays([*table.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["doc_id", "toxic", "text", "k0", "k1"])


@tidy
def _label_counts(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, texts and toxic texts with it, summed for each batch."""
    for table in tables:
        toxic = np.array(table.column(0).to_pylist(), dtype=np.int64)
        for _, text, feature in _features(table.column(1).to_pylist()):
            text, feature, count = _counted(text, feature)
            for level in LEVELS:
                often = count >= level
                found, at = np.unique(feature[often], return_inverse=True)
                sums = np.bincount(at, toxic[text[often]], len(found)).astype(np.int64)
                columns = [found.view(np.int64), np.full(len(found), level, np.int32), np.bincount(at, minlength=len(found)), sums]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["feature", "level", "n", "toxic"])


class Vocabulary:
    """Features (hash, level) by number."""

    def __init__(self, features: list[tuple[int, int]]):
        hashes = np.array([f for f, _ in features], dtype=np.int64).view(np.uint64)
        self.size = len(features)
        self.hashes, row = np.unique(hashes, return_inverse=True)
        self.number = np.full((len(self.hashes), len(LEVELS)), -1, dtype=np.int64)
        self.number[row, [LEVELS.index(level) for _, level in features]] = np.arange(self.size)

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, feature number and count of every feature that the texts have, in order of texts."""
        out = []
        for _, text, feature in _features(texts if self.size else []):
            at = np.searchsorted(self.hashes, feature)
            at[at == len(self.hashes)] = 0
            known = self.hashes[at] == feature
            text, row, count = _counted(text[known], at[known])
            times = np.searchsorted(LEVELS, count, side="right")
            each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            text, row, count = (np.repeat(x, times) for x in (text, row, count))
            number = self.number[row, each]
            kept = number >= 0
            out.append((text[kept], number[kept], count[kept]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


@dataclass
class Index:
    """Examples by feature, in blocks."""

    vocabulary: Vocabulary
    idf: np.ndarray
    ids: np.ndarray  # of examples
    toxic: np.ndarray
    starts: np.ndarray  # feature x block: where the postings of a feature in a block begin
    posting: np.ndarray  # example numbers, by feature, then example
    weight: np.ndarray
    most: np.ndarray  # feature x block: the largest weight
    prior: float

    @staticmethod
    def build(vocabulary, idf, ids, toxic, example, feature, count, prior) -> Index:  # noqa: ANN001
        weight = (1 + np.log(count)) * idf[feature]
        norm = np.sqrt(np.bincount(example, weight**2, len(ids)))
        weight = weight / norm[example]
        order = np.lexsort((example, feature))
        example, feature, weight = example[order], feature[order], weight[order]
        blocks = max(1, -(-len(ids) // BLOCK))
        key = feature * blocks + example // BLOCK
        starts = np.searchsorted(key, np.arange(vocabulary.size * blocks + 1))
        most = np.zeros(vocabulary.size * blocks)
        np.maximum.at(most, key, weight)
        return Index(vocabulary, idf, ids, toxic, starts, example, weight, most.reshape(vocabulary.size, blocks), prior)

    def nearest(self, feature: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a cosine above 0, ties to the smaller number."""
        blocks = self.most.shape[1]
        bounds = weight @ self.most[feature]
        best, cosines = np.zeros(0, dtype=np.int64), np.zeros(0)
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or len(best) == k and bounds[block] < cosines[-1] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for f, x in zip(feature, weight):
                a, b = self.starts[f * blocks + block], self.starts[f * blocks + block + 1]
                scores[self.posting[a:b] - block * BLOCK] += x * self.weight[a:b]
            hit = np.flatnonzero(scores > 0)
            best, cosines = np.concatenate([best, hit + block * BLOCK]), np.concatenate([cosines, scores[hit]])
            order = np.lexsort((best, -np.round(cosines, 12)))[:k]
            best, cosines = best[order], cosines[order]
        return best, cosines

    def score(self, feature: np.ndarray, count: np.ndarray) -> tuple[float, np.ndarray]:
        """Chance of being toxic, and the examples it rests on."""
        weight = (1 + np.log(count)) * self.idf[feature]
        best, cosines = self.nearest(feature, weight / np.sqrt((weight**2).sum()), NEIGHBOURS)
        votes = np.minimum(cosines, 1.0) ** 2
        value = (votes @ self.toxic[best] + PRIOR_WEIGHT * self.prior) / (votes.sum() + PRIOR_WEIGHT)
        return float(np.clip(value, 0, 1)), self.ids[best]


def _wilson(hits: Column, n: Column) -> Column:
    """Lower bound of a share."""
    z2, p = SIGMAS**2, hits / n
    return (p + z2 / (2 * n) - SIGMAS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """The index from labels(doc_id, toxic) of docs(doc_id, text), without held-out rows and null labels.

    A doc_id labelled more than once counts as toxic if any label says so.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = examples / max(1, usable.count())
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40))))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # about `examples` rows
    sample = sample.mapInArrow(_sketch, "doc_id long, toxic int, text string, k0 long, k1 long")
    one = sample.groupBy("k0", "k1", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.doc_id", "toxic", "d.text")
    sample = written(one, "examples")
    counts = sample.select("toxic", "text").mapInArrow(_label_counts, "feature long, level int, n long, toxic long")
    counts = counts.groupBy("feature", "level").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= LEAST_TOXIC)
    marking = counts.withColumn("sure", _wilson(F.col("toxic"), F.col("n"))).filter(F.col("sure") >= PRECISION)
    best = marking.orderBy(F.desc("sure"), "feature", "level").limit(VOCABULARY).select("feature", "level").collect()
    vocabulary = Vocabulary([tuple(r) for r in best])

    @tidy
    def frequencies(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total, rows = np.zeros(vocabulary.size, dtype=np.int64), 0
        for table in tables:
            _, feature, _ = vocabulary.vectors(table.column(0).to_pylist())
            total += np.bincount(feature, minlength=vocabulary.size)
            rows += table.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(total)), -1)), pa.array(np.append(total, rows))], names=["feature", "n"])

    df = docs.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = {r["feature"]: r["n"] for r in df}
    idf = np.array([1 + np.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) for i in range(vocabulary.size)])

    @tidy
    def sparse(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            text, feature, count = vocabulary.vectors(table.column(2).to_pylist())
            ends = np.searchsorted(text, np.arange(table.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int64))) for x in (feature, count)]
            yield pa.RecordBatch.from_arrays([table.column(0), table.column(1), *lists], names=["doc_id", "toxic", "feature", "count"])

    rows = sample.mapInArrow(sparse, "doc_id long, toxic int, feature array<long>, count array<long>").collect()
    rows.sort(key=lambda r: (-len(r["feature"]), r["feature"], r["doc_id"]))  # alike examples share blocks
    without = [r["toxic"] for r in rows if not r["feature"]]
    rows = [r for r in rows if r["feature"]]
    example = np.repeat(np.arange(len(rows)), [len(r["feature"]) for r in rows])
    flat = [np.array([x for r in rows for x in r[c]], dtype=np.int64) for c in ("feature", "count")]
    ids, toxic = np.array([r["doc_id"] for r in rows], dtype=np.int64), np.array([r["toxic"] for r in rows], dtype=float)
    return Index.build(vocabulary, idf, ids, toxic, example.astype(np.int64), *flat, float(np.mean(without)) if without else 0.0)


def score(docs: DataFrame, labels: DataFrame, index: Index | None = None) -> DataFrame:
    """row (all columns of docs), score and evidence (ids of the nearest examples) for every document.

    A null or empty text has no features. Without labels every score is 0.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)
    index = fit(docs, labels) if index is None else index
    shared = docs.sparkSession.sparkContext.broadcast(index)

    @tidy
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for table in tables:
            text, feature, count = model.vocabulary.vectors(table.column(1).to_pylist())
            scores, evidence = np.full(table.num_rows, model.prior), [[]] * table.num_rows
            ends = np.searchsorted(text, np.arange(table.num_rows + 1))
            for i in np.unique(text).tolist():
                scores[i], near = model.score(feature[ends[i] : ends[i + 1]], count[ends[i] : ends[i + 1]])
                evidence[i] = near.tolist()
            columns = [table.column(0), pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "score", "evidence"])

    kind = docs.select(F.struct("*").alias("row")).schema.simpleString()[len("struct<row:") : -1]
    return docs.select(F.struct("*").alias("row"), "text").mapInArrow(run, f"row {kind}, score double, evidence array<long>")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that score at least `threshold`."""
    return score(docs, labels).filter(F.col("score") < threshold).select("row.*")
