import random
import re

import numpy as np
import pytest
from conftest_llm import edge_rows, random_texts
from pyspark.sql import functions as F

from seriesweave.llm import neardup, setsketch
from seriesweave.llm.components import components
from seriesweave.llm.words import tidy, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*(w[i:] for i in range(size))))


def brute(rows, size, percent=80):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), d) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def edited(text, rate, rng):
    return " ".join("changed%d" % rng.randint(0, 999) if rng.random() < rate else w for w in text.split())


@pytest.fixture(scope="module")
def copies():
    rng, out = random.Random(5), []
    for text in random_texts(25, seed=1, words=250, vocabulary=3000, lines=False):
        out.append(text)
        out += [edited(text, rng.choice((0, 0.02, 0.05, 0.08)), rng).upper() for _ in range(rng.randint(0, 8))]
    base = random_texts(1, seed=2, words=900, vocabulary=3000, lines=False)[0]
    out += [edited(base, 0.03, rng) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(make_docs, copies, size, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = copies + [r[:2] for r in edge_rows()]
    got = neardup.near_duplicates(make_docs(rows, clashing=True), size=size).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = brute(rows, size)
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({r.component_id for r in got}) < len(rows) - 30


@pytest.fixture
def only_shuffles(spark):
    """Joins like those of tables that are too large to be broadcast."""

    def start():
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    yield start
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffle_join_gives_the_same(make_docs, copies, only_shuffles):
    docs = make_docs(copies[:60])
    want = neardup.near_duplicates(docs, size=2).collect()
    only_shuffles()
    assert sorted(neardup.near_duplicates(docs, size=2).collect()) == sorted(want)


def test_few_texts_are_shuffled_for_sets(make_docs, copies, only_shuffles):
    """Also by repeated ids and rows without one."""
    only_shuffles()
    rows = copies + [(None, "no id and no copy"), (None, copies[0][1]), (copies[0][0], "an id that comes twice"), copies[1], copies[1]]
    search = neardup._Search(make_docs(rows), 2, 80)
    texts = [copies[1][1], "no id and no copy", "an id that comes twice"]
    of = F.xxhash64(F.lit(0)).isNull()
    for text in texts:
        of = of | (F.col("text_key") == F.xxhash64(F.lit(text)))
    nodes = search.sketches.filter(of).select("node").distinct()
    found = [r.text for r in search.wanted(search.classes.join(nodes, "node")).collect()]
    assert sorted(set(found)) == sorted(texts) and len(found) == 5


def test_sets_are_made_where_links_are_likely(make_docs, monkeypatch):
    """Texts that share bands by chance ask for no sets."""
    rng, base = random.Random(7), random_texts(1, seed=8, words=900, vocabulary=3000, lines=False)[0]
    docs = make_docs(list(enumerate(edited(base, 0.25, rng) for _ in range(40))))
    asked, sets = [], neardup._Search.sets

    def counted(self, nodes):
        asked.append(nodes.count())
        return sets(self, nodes)

    monkeypatch.setattr(neardup._Search, "sets", counted)
    search = neardup._Search(docs, 2, 80)
    assert search.buckets.select("node").distinct().count() > 10
    assert search.run().filter("not kept").isEmpty() and sum(asked) == 0


def test_batches_end_with_memory_given_back():
    closed = []

    def run(tables):
        try:
            yield from tables
        finally:
            closed.append(True)

    assert list(tidy(run)(iter([1, 2]))) == [1, 2] and closed == [True]
    with pytest.raises(ZeroDivisionError):
        list(tidy(lambda tables: (1 // x for x in tables))(iter([0])))


def test_keep_one(edge_docs, no_docs):
    rows = neardup.keep_one(edge_docs, size=2).collect()
    assert sorted((r.doc_id or -1) for r in rows) == [-1, 1, 2, 3, 4, 6, 7, 7, 8]
    assert rows[0].asDict().keys() == dict.fromkeys(edge_docs.columns).keys()
    assert neardup.keep_one(no_docs).collect() == [] and neardup.near_duplicates(no_docs).collect() == []


def test_keep_one_decides_by_row(make_docs, only_shuffles):
    """A repeated id whose texts fall in different components, equal rows, and equal rows without an id."""
    base, other, third = random_texts(3, seed=31, words=400, vocabulary=3000, lines=False)
    rows = [(3, base), (7, base + " end"), (7, other), (8, other), (9, third), (9, third), (None, "no id here"), (None, "no id here"), (5, None), (5, None)]
    want = sorted([(3, base), (7, other), (9, third), (None, "no id here"), (None, "no id here"), (5, None)], key=str)
    docs = make_docs(rows, clashing=True)
    assert sorted(((r.doc_id, r.text) for r in neardup.keep_one(docs).collect()), key=str) == want
    only_shuffles()
    assert sorted(((r.doc_id, r.text) for r in neardup.keep_one(docs).collect()), key=str) == want


def test_shingles_of_every_length():
    texts = ["", None, "a", "a b", "a b c a b c", "  x\ty\n", "z " * 50]
    for size in (1, 2, 5):
        hashes, ends = setsketch.shingles(words(texts), size)
        assert np.diff(ends).tolist() == [len(shingle_set(t, size)) for t in texts]


def test_registers_follow_similarity():
    rng = np.random.default_rng(0)
    for n, shared in ((400, 0.9), (400, 0.6), (60, 0.8), (3, 2 / 3)):
        agree, likely = [], []
        for _ in range(40):
            x = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            both = round(2 * n * shared / (1 + shared))
            a, b = x[: (2 * n + both) // 2 if n > 3 else 3], x[(2 * n - both) // 2 if n > 3 else 1 :]
            b = b if n > 3 else x[1:4] if n > 3 else x[1:3]
            hashes = np.concatenate([np.sort(a), np.sort(b)])
            r = setsketch.registers(hashes, np.array([0, len(a), len(a) + len(b)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((r[0] == r[1]).mean() - true)
            likely.append(setsketch.likely_similarity(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0] - true)
        assert abs(np.mean(agree)) < 0.05 and abs(np.mean(likely)) < 0.05
        assert np.std(likely) < 0.06


def test_registers_merge():
    x = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    one = lambda v: setsketch.registers(v, np.array([0, len(v)]))[0]
    assert (one(x) == np.maximum(one(x[:200]), one(x[150:]))).all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert components(spark.createDataFrame([], "a long, b long")).filter(F.lit(True)).collect() == []
