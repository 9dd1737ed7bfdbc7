"""Best-fit packing of token pieces into sequences with several capacities.

A sequence has room for tokens, pieces of documents, and attention cost (the sum of squared
lengths). Pieces go by falling length, each to the open sequence that fits it under every
capacity and scores best: the least weighted norm of what stays free (`norm`), or the
largest weighted dot product of the piece and the free room (`dot`). A piece that fits
nowhere opens a sequence.

Pieces are dealt by hash to parts of about `part` documents, packed in one task each; each
part leaves few sequences with room, so the loss does not grow with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesweave.llm.tables import small_batches
from seriesweave.llm.tokens import default_tokenizer, encoder
from seriesweave.llm.words import tidy

END_ID = 1
ROWS = 250  # tokenized at once
BATCH_BYTES = 1 << 20  # of texts handed to Python at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, length: int, end_id: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    @tidy
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for table in tables:
            for at in range(0, table.num_rows, ROWS):
                doc_ids, texts = (c.to_pylist() for c in table.slice(at, ROWS).columns)
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids, encode(texts)):
                    raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                    for piece, start in enumerate(range(0, len(raw) // 4, length)):
                        part = raw[start * 4 : (start + length) * 4]
                        rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)) + (part,) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def token_pieces(
    docs: DataFrame, length: int = 4096, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Ids of docs(doc_id, text, ...) in pieces of at most `length`, the end id included.

    A null text is an empty one: its only piece is the end id. Repeated rows give their
    pieces again. with_ids adds the ids as little-endian unsigned 32-bit bytes.
    """
    small_batches(docs.sparkSession, BATCH_BYTES)
    run = _pieces(tokenizer or default_tokenizer(), length, end_id, with_ids)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def best_fit(
    lengths: np.ndarray, tokens: int, pieces: int, cost: int, weights: tuple[float, float, float], score: str
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths must not rise and must fit an empty sequence."""
    n = len(lengths)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    capacity = np.array([tokens, pieces, cost], dtype=np.float64)[:, None]
    scale = np.sqrt(np.array(weights))[:, None] / capacity
    room, numbers = np.empty((3, max(n, 1))), np.empty(n, dtype=np.int64)
    least, opened, count = int(lengths[-1]) if n else 0, 0, 0
    for i, length in enumerate(lengths.tolist()):
        need = np.array([[length], [1.0], [float(length) ** 2]])
        free = room[:, :opened]
        fits = np.flatnonzero(free[0] >= length)
        fits = fits[(free[1, fits] >= 1) & (free[2, fits] >= need[2, 0])]
        if len(fits):
            if score == "norm":
                pick = fits[np.argmin((((free[:, fits] - need) * scale) ** 2).sum(axis=0))]
            else:
                pick = fits[np.argmax((free[:, fits] * need * scale**2).sum(axis=0))]
        else:
            pick = opened
            room[:, pick : pick + 1], numbers[pick] = capacity, count
            opened, count = opened + 1, count + 1
        bins[i], offsets[i] = numbers[pick], tokens - room[0, pick]
        room[:, pick] -= need[:, 0]
        if room[0, pick] < least or room[1, pick] < 1 or room[2, pick] < float(least) ** 2:  # takes nothing more
            opened -= 1
            room[:, pick], numbers[pick] = room[:, opened], numbers[opened]
    return bins, offsets


def pack(
    pieces: DataFrame, documents: int, tokens: int = 4096, most_pieces: int = 4096, most_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm", part: int = 20_000,
) -> DataFrame:
    """Add sequence_id and offset to pieces(doc_id, piece, length, ids_crc32, ...).

    documents is about how many documents the pieces come from and sets the number of
    parts. By default cost binds nothing, as no sequence can cost more than one full piece.
    The result does not depend on the order of rows.
    """
    most_cost = tokens * tokens if most_cost is None else most_cost

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [t for t in tables if t.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        lengths, *ties = (rows[c].fill_null(0).to_numpy() for c in ("length", "doc_id", "piece", "ids_crc32"))
        if lengths.max() > tokens or lengths.max() ** 2 > most_cost or lengths.min() < 1 or most_pieces < 1:
            raise ValueError("a piece must have a token and fit an empty sequence")
        order = np.lexsort((*ties[::-1], -lengths))
        bins, offsets = best_fit(lengths[order], tokens, most_pieces, most_cost, weights, score)
        rows = rows.take(order).append_column("sequence_id", pa.array((TaskContext.get().partitionId() << 32) + bins))
        yield from rows.append_column("offset", pa.array(offsets)).combine_chunks().to_batches(10_000)

    schema = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes) + ", sequence_id long, offset long"
    parts = max(1, round(documents / part))
    return pieces.repartition(parts, F.xxhash64("doc_id", "piece", "ids_crc32", "length")).mapInArrow(run, schema)


def packed(docs: DataFrame, length: int = 4096, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """docs in as few sequences of at most `length` tokens as best fit finds."""
    return pack(token_pieces(docs, length, tokenizer, with_ids=with_ids), docs.count(), length)
