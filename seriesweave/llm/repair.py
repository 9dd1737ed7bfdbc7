"""Conversation structure repair: the cheapest edits that make a conversation well-formed.

The roles of a repaired conversation read `(s?(ua)+)?`: an optional system turn, then users
and assistants in turn. Every row is kept (0), given the role that fits (1) or deleted (2;
blank and duplicate rows must be); turns with an empty text may be inserted anywhere (5
each); a truncated row that stays costs 5 more. Of the cheapest edits the audit, their
initials D, I, K and R in order, that comes first in ASCII is taken.

A conversation is in one of four states: nothing yet, after a system, a user or an assistant
turn. Edits are found by Hirschberg's divide and conquer: forward costs of the first half
and backward costs of the second meet in the middle, the crossing state of least cost is
taken, and both halves are solved on their own, so no table of all rows times states is
kept. Costs tie often; forward vectors therefore carry, next to the cost of every state, the
rank of its least audit. The crossing lies directly behind a row, so that no audit is a
prefix of another one and ranks decide.

The same split works across machines. Rows get a global position in conversation order and
are cut into blocks of BLOCK positions. Forward vectors from all four states sum up the piece
of a conversation in a block; two streaming passes over pieces (backward costs, then
crossings) fix the states at both ends of every piece, and pieces are solved independently.
So a conversation of any length is spread over many tasks; only the texts of one conversation
pass through one task, in small batches, as its digest is one SHA-256.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seriesweave.llm.ordering import in_order
from seriesweave.llm.tables import small_batches, written

BLOCK = 8192
SPACE = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
INITIALS = "sua"
OTHER = 3
SOUND, TRUNCATED, GONE = range(3)
INSERT, DELETE, REROLE, LATE = 5, 2, 1, 5
#: What follows a state in a turn that is inserted or given another role.
NEXT = (USER, USER, ASSISTANT, USER)
#: Turns to insert behind the last row to end well.
CLOSING = (0, 2, 1, 0)
FAR = 1 << 60
#: From any state another one's remaining cost is at most this much higher: what lies further behind is on no cheapest path.
SLACK = 15


def follow(state: int, initial: int) -> int:
    """State after a kept row; -1 where its role does not fit."""
    if initial == 0:
        return SYSTEM if state == START else -1
    if initial == 1:
        return -1 if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else -1


@functools.cache
def options(kind: int, state: int) -> list[tuple[int, str, int]]:
    """(cost, audit, state after the row) of every way to get over a row of this kind (initial * 3 + fault)."""
    initial, fault = divmod(kind, 3)
    found = []
    for inserts in range(3):
        cost, begin = inserts * INSERT, "I" * inserts
        found.append((cost + DELETE, begin + "D", state))
        if fault != GONE:
            cost += LATE * (fault == TRUNCATED)
            kept = follow(state, initial)
            if kept >= 0:
                found.append((cost, begin + "K", kept))
            found.append((cost + REROLE, begin + "R", NEXT[state]))
        state = NEXT[state]
    return found


Forward = tuple[tuple[int, int], ...]  # (cost, rank of the least audit) of each state
Backward = tuple[int, ...]  # remaining cost of each state


def entering(state: int) -> Forward:
    return tuple((0, 0) if s == state else (FAR, 0) for s in range(4))


@functools.lru_cache(maxsize=1 << 16)
def forward(vector: Forward, kind: int) -> tuple[Forward, int]:
    """The vector after one more row, relative to its least cost, and that cost."""
    best: dict[int, tuple[int, int, str]] = {}
    for state, (cost, rank) in enumerate(vector):
        if cost < FAR:
            for more, audit, to in options(kind, state):
                best[to] = min(best.get(to, (FAR, 0, "")), (cost + more, rank, audit))
    low = min(c for c, _, _ in best.values())
    best = {s: x for s, x in best.items() if x[0] <= low + SLACK}
    ranks = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:]))}
    return tuple((best[s][0] - low, ranks[s]) if s in best else (FAR, 0) for s in range(4)), low


@functools.lru_cache(maxsize=1 << 16)
def backward(vector: Backward, kind: int) -> tuple[Backward, int]:
    """The remaining costs before a row, relative to the least, and that cost."""
    costs = [min((c + vector[to] for c, _, to in options(kind, s) if vector[to] < FAR), default=FAR) for s in range(4)]
    low = min(costs)
    return tuple(c - low if c < FAR else FAR for c in costs), low


def crossing(ahead: Forward, behind: Backward) -> int:
    """The state of a cheapest path; of several the one whose audit so far comes first."""
    return min((c + b, rank, s) for s, ((c, rank), b) in enumerate(zip(ahead, behind)) if c < FAR and b < FAR)[2]


def solve(kinds: bytes, begin: int, end: int) -> list[str]:
    """For every row the edits up to and with it (such as `K` or `IR`) that lead from one state to another."""
    edits = [""] * len(kinds)
    left = [(0, len(kinds), begin, end)]
    while left:
        low, high, begin, end = left.pop()
        if high - low == 1:
            edits[low] = min((c, audit) for c, audit, to in options(kinds[low], begin) if to == end)[1]
        elif high > low:
            middle = (low + high) // 2
            ahead, behind = entering(begin), tuple(0 if s == end else FAR for s in range(4))
            for kind in kinds[low:middle]:
                ahead, _ = forward(ahead, kind)
            for kind in reversed(kinds[middle:high]):
                behind, _ = backward(behind, kind)
            state = crossing(ahead, behind)
            left += [(low, middle, begin, state), (middle, high, state, end)]
    return edits


# --- Rows: order, faults, kinds ------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after the damage that crc32 of `conv_id:turn`, modulo 20, does to each.

    0 drops a row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats it, 4 makes
    its role user. A null stands for one space in the key, in roles and in texts.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("_fate"))
    fate = F.col("_fate")
    return rows.filter(fate != 0).select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their global position: by conversation, turn (nulls first), then role and text."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumns({
        "initial": F.coalesce(F.nullif(F.position(F.left("role", F.lit(1)), F.lit("sua")), F.lit(0)) - 1, F.lit(OTHER)),
        "blank": last == "",
        "cut": ~last.isin(".", "!", "?"),
        # Equal rows go by where they were read, so that many of them do not meet in one task.
        "_copy": F.monotonically_increasing_id(),
    }).withColumn("initial", F.when(F.col("role") == "", OTHER).otherwise(F.col("initial")).cast("int"))
    return in_order(rows, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("_copy").asc(), leave=("_copy",))


def _with_faults(ordered: DataFrame) -> DataFrame:
    """conv_id, position, kind and fault (blank, duplicate, truncated or null) of every row.

    A row is a duplicate unless it has the least position among its conversation's rows of
    that role and text; those positions are one aggregate that combines before its shuffle, and
    they meet the rows by position, so no common text gathers in a task.
    """
    digest = [F.xxhash64(F.lit(salt), F.length("role"), "role", "text") for salt in (1, 2)]
    rows = ordered.select("conv_id", "position", "initial", "blank", "cut", digest[0].alias("_a"), digest[1].alias("_b"))
    first = rows.groupBy("conv_id", "_a", "_b").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("_first"))
    rows = rows.join(first, "position", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    code = F.when(fault.isNull(), SOUND).when(fault == "truncated", TRUNCATED).otherwise(GONE)
    return rows.select("conv_id", "position", (F.col("initial") * 3 + code).alias("kind"), fault.alias("fault"))


# --- Pieces: a conversation's rows in one block ----------------------------------


def _pieces(block: pa.Table) -> Iterator[tuple[int | None, int, bytes]]:
    """(conv_id, first position, kinds) of each piece in a block, which is sorted by position."""
    ids, positions = block["conv_id"].to_pylist(), block["position"].to_pylist()
    kinds = bytes(block["kind"].to_pylist())
    starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
    for a, b in zip(starts, [*starts[1:], len(ids)]):
        yield ids[a], positions[a], kinds[a:b]


def _summaries(block: pa.Table) -> pa.Table:
    """Per piece the forward vectors from all four states: 16 costs (absolute) and 16 ranks."""
    rows = []
    for conv_id, position, kinds in _pieces(block.sort_by("position")):
        costs, ranks = [], []
        for state in range(4):
            vector, total = entering(state), 0
            for kind in kinds:
                vector, low = forward(vector, kind)
                total += low
            costs += [c + total if c < FAR else FAR for c, _ in vector]
            ranks += [rank for _, rank in vector]
        rows.append((conv_id, position, costs, ranks))
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


PIECE = "conv_id long, position long, costs array<long>, ranks array<int>"


def _streamed(pieces: DataFrame, step, schema: str, forwards: bool) -> DataFrame:
    """Run step over each conversation's pieces, first to last or last to first, in constant memory.

    step(conv_id, row, carried) gives (values, carried); carried is None at a conversation's first row.
    """
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carried = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    now, carried = row["conv_id"], None
                values, carried = step(row, carried)
                out.append(values)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.types)], schema=types)

    order = F.col("position").asc() if forwards else F.col("position").desc()
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", order)
    return dealt.mapInArrow(run, schema)


def _remaining(row: dict, behind: Backward | None):
    """Remaining costs at a piece's end; what its own begin leaves goes to the piece before."""
    behind = tuple(INSERT * n for n in CLOSING) if behind is None else behind
    costs = row["costs"]
    before = [min((costs[4 * s + t] + behind[t] for t in range(4) if costs[4 * s + t] < FAR and behind[t] < FAR), default=FAR) for s in range(4)]
    low = min(before)
    return (row["conv_id"], row["position"], costs, row["ranks"], list(behind)), tuple(c - low if c < FAR else FAR for c in before)


def _ends(row: dict, state: int | None):
    """The states at both ends of a piece."""
    begin = START if state is None else state
    ahead = tuple(zip(row["costs"][4 * begin : 4 * begin + 4], row["ranks"][4 * begin : 4 * begin + 4]))
    end = crossing(ahead, row["behind"])
    return (row["conv_id"], row["position"], begin, end), end


def _solved(block: pa.Table, ends: pa.Table) -> pa.Table:
    """Every row of a block with its edits, given the states at the ends of its pieces."""
    of = {p: (b, e) for p, b, e in zip(*(ends[c].to_pylist() for c in ("position", "begin", "finish")))}
    block = block.sort_by("position")
    edits = [x for _, position, kinds in _pieces(block) for x in solve(kinds, *of[position])]
    return block.select(["position", "kind", "fault"]).append_column("edits", pa.array(edits, pa.string()))


def edited(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows, in order, with what to do to each: position, fault and edits (`I` for each turn to insert before it, then D, K or R).

    rows(conv_id, turn, role, text). Null roles and texts are one space. Turns to insert behind a
    conversation's last row follow from the state it ends in (`repair` adds them).
    """
    ordered = _ordered(rows)
    kinds = written(_with_faults(ordered).withColumn("block", F.floor(F.col("position") / block)), "kinds")
    pieces = written(kinds.drop("fault").groupBy("block").applyInArrow(_summaries, PIECE), "pieces")
    pieces = written(_streamed(pieces, _remaining, PIECE + ", behind array<long>", False), "pieces")
    ends = written(_streamed(pieces, _ends, "conv_id long, position long, begin int, finish int", True), "ends")
    ends = ends.withColumn("block", F.floor(F.col("position") / block)).groupBy("block")
    found = kinds.groupBy("block").cogroup(ends).applyInArrow(_solved, "position long, kind int, fault string, edits string")
    return ordered.join(found, "position")


# --- Conversations ----------------------------------------------------------------


class _Conversation:
    """What is known of one conversation after some of its rows: counts, audit and a running digest."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.first, self.last = conv_id, 0, None, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before, self.cost, self.state = 0, None, 0, START
        self.audit: list[str] = []
        self.digest, self.any = hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def _insert(self) -> None:
        self.state = NEXT[self.state]
        self._say(ROLES[self.state], "")
        self.cost += INSERT

    def add(self, turn: int | None, role: str | None, text: str | None, kind: int, fault: str | None, edits: str) -> None:
        if turn is not None:  # in ascending order
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if fault:
            self.faults[fault] += 1
        initial = kind // 3
        if self.before is not None:
            self.illegal += (self.before, initial) not in ((0, 1), (1, 2), (2, 1))
        self.before = initial
        for _ in edits[:-1]:
            self._insert()
        act = edits[-1]
        if act == "D":
            self.cost += DELETE
        else:
            self.state = follow(self.state, initial) if act == "K" else NEXT[self.state]
            self.cost += LATE * (kind % 3 == TRUNCATED) + REROLE * (act == "R")
            self._say(role if act == "K" else ROLES[self.state], text)
        self.audit.append(edits)

    def row(self) -> tuple:
        closing = CLOSING[self.state]
        for _ in range(closing):
            self._insert()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit) + "I" * closing, self.digest.hexdigest())


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in REPORT.split(", "))])
    now, done = None, []
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            conv_id, *rest = (c[i].as_py() for c in columns)
            if now is None or now.conv_id != conv_id:
                if now:
                    done.append(now.row())
                now = _Conversation(conv_id)
            now.add(*rest)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
            done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), schema.types)], schema=schema)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of rows(conv_id, turn, role, text): gaps, faults, cost, audit and digest of the repair.

    `gaps` are the turn numbers missing between the least and the greatest; a null turn stands
    first and has no part in it. `illegal` counts neighbours other than system-user, user-assistant
    and assistant-user. Rows with one turn number go by role and text. A null conv_id is a
    conversation like any other. Repeated rows are duplicates. An empty table gives no rows, and
    further columns are ignored. Texts of any length pass through whole, a batch at a time.
    """
    small_batches(rows.sparkSession)
    found = edited(rows, block)
    gone = F.col("edits").endswith("D")  # their texts are not needed any more
    plain = lambda c: F.when(~gone, F.col(c)).alias(c)
    rows = found.select("conv_id", "position", "turn", plain("role"), plain("text"), "kind", "fault", "edits")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").drop("position")
    return dealt.mapInArrow(_told, REPORT)


def repair_damaged(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repair of every original conversation after `damage`; one that lost all rows has zeros and empty results."""
    found = repair(damage(conversations), block).withColumnRenamed("conv_id", "_id").withColumn("_found", F.lit(True))
    every = conversations.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    empty: dict[str, Column] = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    names = [c.split()[0] for c in REPORT.split(", ")]
    return out.select("conv_id", *(F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in names[1:]))
