import hashlib
import random
import zlib

import pytest

from seriesweave.llm import prefixtrie

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All nodes of the contract, from whole sequences in memory."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    built = {c: tuple(own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :]) for c in own}
    members, children = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in below) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[x] for x in below)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def conversations(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * count), count):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["Hello.", "Ünd?", None, "", "Tell me more."]) if rng.random() < 0.7 else f"{rng.random()}"
            rows.append((c, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", None]), text))
    return rows


def checked(spark, rows, monkeypatch=None, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(prefixtrie, name, value)
    got = prefixtrie.family_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert sorted(tuple(r)[:8] for r in got) == brute(rows)
    # A tour: every place once, and subtrees nest.
    assert sorted(x for r in got for x in (r.enter, r.exit)) == list(range(2 * len(got)))
    return got


def test_trie_equals_brute_force(spark):
    checked(spark, conversations(1, 120, 9))


@pytest.mark.parametrize("sizes", [{"CELL": 4, "SIBLINGS": 4, "BLOCK": 5, "CHUNK": 3}])
def test_links_between_blocks_and_cells(spark, monkeypatch, sizes):
    rows = conversations(2, 60, 25)
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(40) for t in range(3)]  # a very common conversation
    rows += [(2000, t, "user", "again") for t in range(60)]  # a long one
    checked(spark, rows, monkeypatch, **sizes)


def test_edges(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert prefixtrie.family_trie(df).collect() == []
    rows = [(None, 1, "user", "no conversation"), (-3, None, None, None), (-3, 0, "user", "long words " * 100_000), (-3, 0, "user", "long words " * 100_000)]
    turnless = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows += [(turnless, 0, "user", "left out")]
    clashing = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 as position", "2 as a", "'x' as depth", "conv_id as node")
    got = prefixtrie.family_trie(clashing).collect()
    assert sorted(tuple(r)[:8] for r in got) == brute(rows)
