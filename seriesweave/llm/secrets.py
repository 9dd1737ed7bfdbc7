"""Secret scans: fixed patterns, and zstandard novelty of strings in sensitive context.

Three kinds of spans come from patterns: `assign` (a sensitive name, `=` or `:`, a value),
`access` (access key ids) and `hex` (long hexadecimal runs). A fourth, `novel`, needs no
pattern of the secret itself: a run of key characters close to a sensitive word is a candidate,
and what counts is how many bytes it adds to the zstandard frame of its surroundings, with
a dictionary of the corpus's own identifiers in place. Words, identifiers, placeholders, paths and
whatever the text around says already cost next to nothing; a random key costs almost as many
bytes as it has information.

Two passes. The first reads all texts as bytes, finds pattern spans and candidates, and writes
one small row per document, without its text. From the surroundings of all candidates come the
identifiers of the dictionary, counted over all documents; the second pass measures the
candidates against it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesweave.llm.tables import small_batches, written

# What the patterns look for.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

#: Words that make the text around them sensitive.
SENSITIVE = re.compile(
    rb"pass(?:word|wd|phrase|code)?\b|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|[a-z]key\b|_key\b|credential|bearer|authori[sz]ation|auth[_-]|signature|jwt|session[_-]?id|://[^\s:/@]+:",
    re.IGNORECASE,
)
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"cred", b"bearer", b"auth", b"signature", b"jwt", b"session", b"://")
RUN = re.compile(rb"[A-Za-z0-9+/_=.-]{12,}")
IDENTIFIER = re.compile(rb"[A-Za-z_]{3,32}")
INNER = re.compile(rb"(?=[A-Za-z_./-]{4})[A-Za-z]+(?:[_./-]+[A-Za-z]+)*_?")

#: Bytes before a candidate in which a sensitive word must stand, and bytes either side that count as its surroundings.
REACH, AROUND = 48, 192
#: Marginal compressed bytes per byte of a candidate from which it is novel. Short random keys take 0.8 to 1.1 (zstandard
#: hardly packs literals of so few bytes), strings made of known words 0.3 to 0.65.
NOVEL = 0.75
#: A candidate has at least this many bytes and two of: lower case, upper case inside, digits.
LEAST_NOVEL = 16
DICTIONARY_BYTES = 32 << 10
LEAST_TIMES = 2
LEVEL = 19

FOUND = (
    "doc_id long, spans array<struct<kind:int,start:long,stop:long>>, "
    "candidates array<struct<start:long,stop:long,before:binary,value:binary,after:binary>>"
)

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("before", pa.binary()), ("value", pa.binary()), ("after", pa.binary())])
_SCANNED = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), ("candidates", pa.list_(_CANDIDATE))])
REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def base_spans(text: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, stop) in bytes of all pattern matches; low is the text with A-Z in lower case."""
    spans = []
    if any(name in low for name in NAMES):
        spans += [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    if b"AKIA" in text:
        spans += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def mixed(value: bytes) -> bool:
    """Two of: lower case, upper case after the first letter of a run, digits."""
    return bool(re.search(rb"[a-z]", value)) + bool(re.search(rb"[0-9]", value)) + bool(re.search(rb"[A-Za-z0-9][A-Z]", value)) >= 2


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and stops of the stretches that spans cover."""
    starts, stops = [], []
    for _, a, b in spans:
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    return starts, stops


def candidates(text: bytes, low: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Byte spans of mixed runs just behind a sensitive word, apart from those that a pattern span touches."""
    if not any(hint in low for hint in HINTS):
        return []
    words = [m.end() for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, stops = _merged(taken)
    found = []
    for m in RUN.finditer(text):
        start, stop = m.span()
        # Of name=value in one run, the value; what fills up base 64 at the end stays.
        start = max(start, text.rfind(b"=", start, max(start, stop - LEAST_NOVEL)) + 1)
        word = bisect_right(words, start) - 1
        if stop - start < LEAST_NOVEL or word < 0 or words[word] < start - REACH:
            continue
        span = bisect_left(starts, stop) - 1  # the last that begins before the run ends
        if (span < 0 or stops[span] <= start) and mixed(text[start:stop]):
            found.append((start, stop))
    return found


class _Points:
    """Code points before a byte, for ascending bytes of one text."""

    def __init__(self, text: bytes):
        self.plain = text.isascii()
        self.at = None if self.plain else np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])

    def __call__(self, byte: int) -> int:
        return byte if self.plain else int(self.at[byte])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        texts = batch.column(1)
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            text = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
            low = text.lower()  # of bytes: A-Z alone
            spans = base_spans(text, low)
            near = candidates(text, low, spans)
            if not spans and not near:
                rows.append((doc_id, [], []))
                continue
            point = _Points(text)
            rows.append((
                doc_id, [(kind, point(a), point(b)) for kind, a, b in spans],
                [(point(a), point(b), text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]) for a, b in near],
            ))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCANNED.types)], schema=_SCANNED)


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The identifiers around each document's candidates (value: null) and inside them (value: its hash), every one once a document."""
    types = pa.schema([("word", pa.string()), ("value", pa.int64())])
    for batch in batches:
        out: list[tuple[str, int | None]] = []
        for found in batch.column(0).to_pylist():
            around = {(w, None) for c in found for part in (c["before"], c["after"]) for w in IDENTIFIER.findall(part)}
            inside = {(w, xxhash.xxh3_64_intdigest(c["value"]) >> 1) for c in found for w in INNER.findall(c["value"])}
            out += [(w.decode(), value) for w, value in (*around, *inside)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.types)], schema=types)


def identifier_dictionary(found: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The identifiers that stand around candidates in several documents, or in several different candidates.

    Copies of one candidate count once, so that a secret does not become known by being copied. The
    most common come last, as zstandard looks back from the end. Words are counted and ranked on
    the executors; at most `size` bytes go through the driver.
    """
    words = found.filter(F.size("candidates") > 0).select("candidates").mapInArrow(_identifiers, "word string, value long")
    counts = words.groupBy("word", "value").agg(F.count("*").alias("n"))
    counts = counts.groupBy("word").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(1)).alias("n")).filter(F.col("n") >= LEAST_TIMES)
    top = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size // 4).collect()]
    total = 0
    for i, word in enumerate(top):
        total += len(word) + 1
        if total > size:
            top = top[:i]
            break
    return " ".join(reversed(top)).encode()


class Novelty:
    """Marginal compressed bytes of strings in their surroundings."""

    def __init__(self, dictionary: bytes, level: int = LEVEL):
        self.known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        if self.known:
            self.known.precompute_compress(level=level)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=self.known, write_content_size=False, write_checksum=False)

    def __call__(self, before: bytes, value: bytes, after: bytes) -> float:
        """Bytes that the value adds to the frame of its surroundings, per byte of the value."""
        around = len(self.pack.compress(before + b" " + after))
        return (len(self.pack.compress(before + value + b" " + after)) - around) / max(1, len(value))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in sorted(spans))


def _measured(dictionary: bytes, least: float):
    schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in REPORT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            out = []
            for doc_id, spans, near in zip(*(batch.column(i).to_pylist() for i in range(3))):
                base = [(s["start"], s["kind"], s["stop"]) for s in spans]
                more = [(c["start"], 3, c["stop"]) for c in near if novelty(c["before"], c["value"], c["after"]) >= least]
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                out.append((doc_id, *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + more), len(more)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run


def scan(docs: DataFrame, novel: float = NOVEL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_novel of every row of docs(doc_id, text, ...).

    `spans` lists kind:start:end in code points, the end not included, by start and then kind in the order
    of KINDS, joined by commas. Pattern spans of one kind do not overlap, those of several kinds may;
    `novel` ones touch no pattern span. A null text is an empty one and has no spans. Repeated rows and
    null ids are scanned like others; further columns are ignored; an empty table gives no rows.
    Texts are read whole, however long.
    """
    small_batches(docs.sparkSession)
    found = written(docs.select("doc_id", "text").mapInArrow(_scan, FOUND), "scanned")
    return found.mapInArrow(_measured(identifier_dictionary(found), novel), REPORT)
