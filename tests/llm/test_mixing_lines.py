import re
from collections import Counter, defaultdict

import pytest
from conftest_llm import edge_rows, random_texts

from seriesweave.llm import lines, mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(1, 2, 3)):
    """Water filling, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        goal = {s: 3 * sizes[s] if s in capped else rest * weight[s] / free for s in sizes}
        more = {s for s in sizes if goal[s] > 3 * sizes[s]}
        if not more:
            return goal
        capped |= more


@pytest.fixture(scope="module")
def mixed_rows():
    rows, at = [], 0
    for source, n in (("a", 200), ("B", 20), ("é", 300), (None, 150), ("tiny", 1)):
        for text in random_texts(n, seed=n):
            rows.append((at, text, "en", source, 0))
            at += 1
    return rows


def test_mix_meets_targets(make_docs, mixed_rows):
    docs = make_docs(mixed_rows)
    got = mixing.mix_sizes(docs).collect()
    sizes = defaultdict(int)
    for r in mixed_rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r[0], size(r[1])) for r in mixed_rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    for source, n in taken.items():
        assert abs(n - want[source]) <= 300
    again = mixing.mix_sizes(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    rows = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert rows == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_keeps_expectations(make_docs):
    """Over many sources alike, every place in the order of sizes is taken about equally often."""
    rows = [(s * 100 + i, "w " * (i + 1), "en", f"s{s:03}", 0) for s in range(90) for i in range(12)]
    got = mixing.mix_sizes(make_docs(rows)).collect()
    share = defaultdict(list)
    for r in got:
        if int(r.source[1:]) % 3 == 0:  # a fraction of one half
            share[r["size"]].append(r.copies)
    assert all(0.15 < sum(c) / len(c) < 0.85 for c in share.values())


def test_mix_edges(edge_docs, no_docs):
    got = mixing.mix_sizes(edge_docs).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((r[0] or -1, size(r[1])) for r in edge_rows())
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == sum(r.copies for r in got)
    assert all(r["size"] == -1 and r["key"] == -1 for r in rows)
    assert mixing.mix_sizes(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []


def clean(pages, ratio, least=3):
    blank = " \t\r\x0b\x0c"
    total, on = Counter(), defaultdict(Counter)
    for site, text in pages:
        total[site] += 1
        on[site].update({x.strip(blank) for x in (text or "").split("\n")} - {""} if text is not None else ())
    out = []
    for site, text in pages:
        if text is None:
            out.append((site, None, 0, 0))
            continue
        rows = text.split("\n")
        bad = {x for x, n in on[site].items() if n >= least and n > ratio * total[site]}
        kept = [x for x in rows if x.strip(blank) not in bad]
        if not any(x.strip(blank) for x in kept):
            kept = rows
        out.append((site, "\n".join(kept), len(rows), len(rows) - len(kept)))
    return out


def test_lines_against_brute_force(make_docs):
    texts = random_texts(120, seed=4, words=20)
    rows = []
    for i, text in enumerate(texts):
        site = ("hot", "hot", "cold", None)[i % 4]
        footer = "\n  all rights reserved \n" if i % 3 == 0 else "\n"
        rows.append((i, text + footer + ("menu\tx\n\nmenu\tx" if i % 7 == 0 else ""), "en", site, 0))
    rows += [(200 + i, "menu\tx\nall rights reserved", "en", "hot", 0) for i in range(4)] + edge_rows()
    docs = make_docs(rows, clashing=True)
    got = lines.drop_boilerplate(docs).select("source", "text", "lines_total", "lines_dropped").collect()
    order = lambda r: tuple((x is None, str(x)) for x in r)
    want = clean([(r[3], r[1]) for r in rows], lines.RATIO)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert sum(r[3] for r in want) > 20


def test_lines_keep_all_columns(edge_docs, no_docs):
    out = lines.drop_boilerplate(edge_docs)
    assert set(out.columns) == set(edge_docs.columns)
    assert out.count() == len(edge_rows())
    assert lines.drop_boilerplate(no_docs).collect() == []
