import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest_llm import edge_rows, random_texts

from seriesweave.llm import fingerprints, topk, toxicity

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, every, k):
    fine = []
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, np.floor(np.array(v, dtype=np.float32).astype(float) * 256).astype(np.int64)))
    out = []
    for n, (q, v) in enumerate(fine):
        if q % every == 0:
            best = sorted((-int(v @ w), i) for m, (i, w) in enumerate(fine) if m != n)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 256), (40, 5)])
def test_top_k_is_exact(spark, blocks):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * rng.uniform(0.2, 3, size=(6, 1))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.1], 0) for i in range(600)]
    rows += [(1000 + i, rows[50][1], 0) for i in range(120)]  # a very common vector, all ties
    rows += [(2000, None, 0), (2050, [], 0), (2100, [1.0] * 7 + [None], 0), (2150, [float("nan")] * 8, 0), (2200, [float("inf")] + [0.0] * 7, 0)]
    rows += [(None, [1.0] * 8, 0), rows[100], rows[100], (3000, [0.0] * 8, 0)]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), 50, 5, *blocks).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 50, 5)


@pytest.mark.parametrize("blocks", [(4096, 256), (40, 5)])
def test_rows_that_repeat_an_id(spark, blocks):
    """Different vectors of one id are rows of their own, also where one id holds a third of all rows."""
    rows = [(1, [1.0, 1.0], 0), (1, [5.0, 5.0], 0), (50, [1.0, 1.0], 0), (50, [2.0, -1.0], 0)]
    rows += [(100, [float(i % 7), float(i % 5)], 0) for i in range(40)] + [(200 + i, [float(-i), 1.0], 0) for i in range(1, 80)]
    extra = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as row", "2 as pivot", "3 as v", "4 as score")
    got = topk.top_k(extra, 50, 5, *blocks).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 50, 5)


def test_top_k_of_few_and_of_large_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert topk.top_k(make([])).collect() == []
    rows = [(0, [1.0, 2.0], 0), (50, [-1.0, 0.5], 0), (7, [3.0, 3.0], 0)]
    assert sorted(map(tuple, topk.top_k(make(rows)).collect())) == brute_top(rows, 50, 5)
    rows = [(i, [float(2**20 + i), float(3 * i)], 0) for i in range(60)]
    assert sorted(map(tuple, topk.top_k(make(rows)).collect())) == brute_top(rows, 50, 5)


def test_bounds_of_trees_hold():
    rng = np.random.default_rng(0)
    a = topk.Tree.build(rng.normal(size=(300, 5)) * 100, np.arange(300))
    b = topk.Tree.build(rng.normal(size=(500, 5)) * 100, np.arange(500))
    assert any(a.children) and any(b.children)
    for i in range(len(a.start)):
        for j in range(len(b.start)):
            own = (a.vectors[a.start[i] : a.stop[i]] @ b.vectors[b.start[j] : b.stop[j]].T).max()
            assert own <= topk.bound(a, i, b, j)


INSULTS = ("zorgon", "blatfink", "quimble")


def labelled(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i, text in enumerate(random_texts(n, seed=seed, words=120, vocabulary=2000)):
        toxic = rng.random() < 0.2
        if toxic:
            words = text.split(" ")
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS).upper() + rng.choice(("", "!", "isch.")))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, make_docs):
    rows, labels = labelled(1200, 1)
    docs = make_docs(rows + [r[:2] for r in [(10_000 + (r[0] or 0), *r[1:]) for r in edge_rows()]], clashing=True)
    kind = "doc_id long, toxic int"
    given = spark.createDataFrame([*labels, (None, 1), (3, None)], kind)
    got = toxicity.score(docs, given).select("row.doc_id", "score", "evidence").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in held]
    assert len(held) > 200 and sum(right) / len(right) > 0.97
    assert all(i in truth and zlib.crc32(str(i).encode()) % 4 != 2 for r in got for i in r.evidence)
    flipped = spark.createDataFrame([(i, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t) for i, t in labels], kind)
    again = toxicity.score(docs, flipped).select("row.doc_id", "score").collect()
    assert sorted((r.doc_id, r.score) for r in again) == sorted((r.doc_id, r.score) for r in got)
    kept = toxicity.without_toxic(docs, given)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.3 for r in got)


def test_toxicity_without_labels(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(edge_docs, none).collect()
    assert len(got) == len(edge_rows()) and all(r.score == 0 for r in got)
    assert toxicity.score(no_docs, none).collect() == []


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    n, size = 700, 30
    x = (rng.random((n, size)) < 0.15) * rng.integers(1, 5, (n, size))
    x = x[x.sum(axis=1) > 0]
    example, feature = np.nonzero(x)
    vocabulary = toxicity.Vocabulary([(i, 1) for i in range(size)])
    idf = rng.uniform(1, 5, size)
    index = toxicity.Index.build(vocabulary, idf, np.arange(len(x)), np.zeros(len(x)), example, feature, x[example, feature], 0.0)
    dense = np.where(x > 0, (1 + np.log(np.maximum(x, 1))) * idf, 0)
    dense /= np.sqrt((dense**2).sum(axis=1))[:, None]
    for q in dense[:60]:
        f = np.flatnonzero(q)
        best, cosines = index.nearest(f, q[f], 15)
        scores = dense @ q
        order = np.lexsort((np.arange(len(x)), -np.round(scores, 12)))[:15]
        assert best.tolist() == order.tolist() and np.allclose(cosines, scores[order])


def test_edited_texts(make_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 7)
    rows = list(enumerate(random_texts(60, seed=8), 1))
    rows += [(d + 100 if d else d, t) for d, t, *_ in edge_rows() if d != 6 and d != 7] + [(500, rows[3][1])]
    got = {r.doc_id: r for r in fingerprints.edited(make_docs(rows, clashing=True)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for i, (d, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)]
        half = len(text) // 2
        changed = text[: len(text) - half] + (following[1] or "")[:half]
        r, n = got[d], got[following[0]]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        differ = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 64
        assert r.near_next == differ(r.fingerprint, n.fingerprint) and r.near_edited == differ(r.fingerprint, r.edited_fingerprint)
    assert got[500].fingerprint == got[4].fingerprint
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long])


def test_repeated_ids_and_no_documents(edge_docs, no_docs):
    assert fingerprints.edited(edge_docs).count() == len(edge_rows())
    assert fingerprints.edited(no_docs).collect() == [] and fingerprints.fingerprint(no_docs).collect() == []
    assert {r.fingerprint for r in fingerprints.fingerprint(edge_docs.filter("doc_id in (1, 2, 3)")).collect()} == {"0" * 16}


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(0)
    found = []
    for _ in range(30):
        base = rng.getrandbits(64)
        found += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(6)]
    df = spark.createDataFrame([(f"{x:016x}",) for x in found] + [(None,)], "fingerprint string")
    got = {tuple(r) for r in fingerprints.within_radius(df, 3).collect()}
    values = sorted({f"{x:016x}" for x in found})
    want = {(a, b, bin(int(a, 16) ^ int(b, 16)).count("1")) for i, a in enumerate(values) for b in values[i + 1 :]}
    assert got == {w for w in want if w[2] <= 3}


def test_toxicity_gives_memory_back_after_every_batch(monkeypatch):
    """Workers of the pipeline's first stage go on to the others."""
    import pyarrow as pa

    from seriesweave.llm import toxicity, words

    given, asked = [], []
    monkeypatch.setattr(words, "give_back", lambda: given.append(len(asked)))

    def batches():
        for i in range(3):
            asked.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([1, 0]), pa.array(["bad words here", None])], names=["toxic", "text"])

    rows = [r for b in toxicity._label_counts(batches()) for r in b.to_pylist()]
    assert given == [1, 2, 3, 3] and sum(r["toxic"] for r in rows if r["level"] == 1) == 3 * 4  # bad, words, word, here
