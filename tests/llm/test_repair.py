import hashlib
import random
import zlib

import pytest

from seriesweave.llm import repair

CONVERSATIONS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, roles and texts) by trying all edits, keeping the least (cost, audit) of each state."""
    best = {"": (0, "", ())}

    def insert(states):
        for _ in range(3):
            for state, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    to = STEP.get((state, role[0]))
                    if to:
                        new = (cost + 5, audit + "I", (*out, (role, "")))
                        states[to] = min(states.get(to, new), new)
        return states

    for role, text, fault in rows:
        found = {}
        # Insertions may come before any edit, so paths that are dearer so far count too.
        for state, (cost, audit, out) in [x for s in best for x in insert({s: best[s]}).items()]:
            ways = [(cost + 2, audit + "D", out, state)]
            if fault in (None, "truncated"):
                late = 5 * (fault == "truncated")
                to = STEP.get((state, role[:1]))
                if to:
                    ways.append((cost + late, audit + "K", (*out, (role, text)), to))
                for other in ("user", "assistant"):
                    to = STEP.get((state, other[0]))
                    if to:
                        ways.append((cost + late + 1, audit + "R", (*out, (other, text)), to))
            for *new, to in ways:
                found[to] = min(found.get(to, tuple(new)), tuple(new))
        best = found
    ends = insert(dict(best))
    return min(ends[s] for s in ("", "a") if s in ends)


def brute(rows):
    """The contract, row by row."""
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, [])
        fate = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        by[conv_id] += [(turn, role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv_id, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, said = cheapest([(r, t, f) for (_, r, t), f in zip(turns, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv_id] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def conversations(seed, count, longest):
    rng = random.Random(seed)
    texts = ["Good.", "Why?", "no end", "", " \n", "Fine!", "and so on", "Ünd? ", None, "Right.", "stop. now", "Yes."]
    rows = []
    for conv_id in range(count):
        turns = rng.randint(1, longest)
        for turn in range(turns):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(["system", "user", "assistant", "tool", None, ""])
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."
            rows.append((conv_id, None if rng.random() < 0.03 else turn + (rng.random() < 0.05), role, text))
    return rows


@pytest.mark.parametrize("block", [repair.BLOCK, 7])
def test_repair_equals_brute_force(spark, block):
    """Also where most conversations lie in several blocks."""
    rows = conversations(1, 150, 9) + [(1000 + r[0], *r[1:]) for r in conversations(2, 6, 80)]
    rows += [(None, t, r, x) for _, t, r, x in conversations(3, 3, 8)]
    got = {r[0]: tuple(r)[1:] for r in repair.repair_damaged(spark.createDataFrame(rows, CONVERSATIONS), block).collect()}
    assert got == brute(rows)


def test_edges(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone."), (None, None, None, None)] + [(9, 4, "user", "Same words.")] * 40 + [(10, 1, "user", "long words " * 200_000)]
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 as position", "2 as edits", "'x' as kind", "conv_id as block")
    got = {r[0]: tuple(r)[1:] for r in repair.repair_damaged(df, 5).collect()}
    assert got == brute(rows)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repair.repair_damaged(df.limit(0)).collect() == []


def test_every_split_finds_the_least_audit():
    """Short sequences of kinds, all of them, against trying everything."""
    names = ("system", "user", "assistant", "x")
    faults = (None, "truncated", "blank")
    rng = random.Random(4)
    for n in range(1, 9):
        for _ in range(150):
            kinds = bytes(rng.choice([0, 3, 6, 3, 6, 1, 4, 7, 5, 8, 9]) for _ in range(n))
            ahead = repair.entering(repair.START)
            for kind in kinds:
                ahead, _ = repair.forward(ahead, kind)
            end = repair.crossing(ahead, tuple(5 * c for c in repair.CLOSING))
            got = "".join(repair.solve(kinds, repair.START, end)) + "I" * repair.CLOSING[end]
            assert got == cheapest([(names[k // 3], "t", faults[k % 3]) for k in kinds])[1]
