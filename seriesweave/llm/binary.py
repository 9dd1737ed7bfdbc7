"""Token ids in seekable zstandard files.

Every document is one or more independent zstandard frames, so that a reader decompresses
only the documents asked for. A file ends with two skippable frames: an index (document
ids and their numbers of frames) and a seek table in the public seekable format, with
compressed size, size and checksum (low 32 bits of XXH64) of every frame.

Files hold the documents in ascending doc_id order, file after file; null ids come last,
repeated ids follow each other. A null text is an empty one and holds the end id alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesweave.llm.tables import new_dir, small_batches, written
from seriesweave.llm.tokens import default_tokenizer, encoder

# Fixed values of the public seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_END = 0x8F92EAB1
CHECKSUMS = 0x80

FRAME_IDS = 1 << 26
END_ID = 1
COLUMNS = ("doc_id", "text")


def _frames(path: str, end_id: int, bounds: list[int]):
    schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("part", pa.int32()),
                        ("ids", pa.int64()), ("check", pa.int64()), ("frame", pa.binary())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        pack = zstandard.ZstdCompressor(level=1, write_checksum=True)
        edges = np.array(bounds, dtype=np.int64)
        for table in tables:
            doc_ids, texts = table.column(0).to_pylist(), table.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[at : at + 500], encode(texts[at : at + 500])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    bucket = len(edges) + 1 if doc_id is None else int(np.searchsorted(edges, doc_id, side="right"))
                    tie = xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1
                    for part, start in enumerate(range(0, len(ids), FRAME_IDS)):
                        raw = ids[start : start + FRAME_IDS].tobytes()
                        check = xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF
                        rows.append((bucket, doc_id, tie, part, len(raw) // 4, check, pack.compress(raw)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


class _File:
    """One open file; frames go straight to it, the index and the table stay small."""

    def __init__(self, folder: str, bucket: int):
        self.bucket, self.system, self.ids = bucket, *fs.FileSystem.from_uri(folder)[:1], 0
        place = fs.FileSystem.from_uri(folder)[1]
        self.system.create_dir(place, recursive=True)
        self.place = f"{place}/part-{bucket:09d}.zst"
        self.own = f"{self.place}.{TaskContext.get().taskAttemptId()}"
        self.name = f"{folder}/part-{bucket:09d}.zst"
        self.out = self.system.open_output_stream(self.own)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.parts: list[int] = []

    def add(self, doc_id: int | None, part: int, ids: int, check: int, frame: bytes) -> None:
        self.out.write(frame)
        self.entries.append((len(frame), ids * 4, check))
        self.ids += ids
        if part:
            self.parts[-1] += 1
        else:
            self.docs.append(doc_id or 0)
            self.nulls.append(doc_id is None)
            self.parts.append(1)

    def close(self) -> tuple[int, str, int, int]:
        n = len(self.docs)
        index = np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.parts, "<u4").tobytes()
        index = n.to_bytes(8, "little") + index
        self.out.write(np.array([SKIPPABLE_INDEX, len(index)], "<u4").tobytes() + index)
        self.entries.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = np.array(self.entries, "<u4").tobytes() + len(self.entries).to_bytes(4, "little")
        table += bytes([CHECKSUMS]) + SEEKABLE_END.to_bytes(4, "little")
        self.out.write(np.array([SKIPPABLE_SEEK, len(table)], "<u4").tobytes() + table)
        self.out.close()
        self.system.move(self.own, self.place)  # a repeated task replaces the file with the same bytes
        return self.bucket, self.name, n, self.ids


def _writer(folder: str):
    schema = pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done = None, []
        for table in tables:
            columns = [table.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            for i, (bucket, *rest) in enumerate(zip(*columns)):
                if file is None or file.bucket != bucket:
                    if file:
                        done.append(file.close())
                    file = _File(folder, bucket)
                file.add(*rest, table.column(6)[i].as_py())
        if file:
            done.append(file.close())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

    return run


def write_ids(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, docs_per_file: int = 20_000
) -> DataFrame:
    """Write the ids of docs(doc_id, text, ...) below folder, a URI that all machines reach.

    Returns one row per file: bucket (files in ascending order of ids), path, docs, ids.
    Bounds between files are quantiles of doc_id; only they go through the driver, one
    number per file. Texts are encoded and compressed before the shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*COLUMNS)
    count = docs.count()
    files = max(1, -(-count // docs_per_file))
    bounds: list[int] = []
    if files > 1:
        at = [i / files for i in range(1, files)]
        found = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * files)).alias("b")).first()
        bounds = sorted(set(found.b or []))
    frames = docs.mapInArrow(
        _frames(tokenizer or default_tokenizer(), end_id, bounds),
        "bucket int, doc_id long, tie long, part int, ids long, check long, frame binary",
    )
    ordered = frames.repartition(len(bounds) + 2, "bucket").sortWithinPartitions("bucket", "doc_id", "tie", "part")
    return written(ordered.mapInArrow(_writer(folder), "bucket int, path string, docs long, ids long"), "files")


class Reader:
    """Reads single documents of one file; checks every frame it decompresses."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(9, size - 9)
        if int.from_bytes(tail[5:], "little") != SEEKABLE_END or tail[4] != CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        n = int.from_bytes(tail[:4], "little")
        table = np.frombuffer(self.file.read_at(n * 12, size - 9 - n * 12), "<u4").reshape(n, 3).astype(np.int64)
        ends = np.cumsum(table[:, 0])
        index = self.file.read_at(int(table[-1, 0]), int(ends[-1] - table[-1, 0]))[8:]
        docs = int.from_bytes(index[:8], "little")
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8)
        self.nulls = np.frombuffer(index, "u1", docs, 8 + 8 * docs).astype(bool)
        parts = np.frombuffer(index, "<u4", docs, 8 + 9 * docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(parts)])
        self.starts, self.sizes, self.raw, self.checks = ends - table[:, 0], table[:, 0], table[:, 1], table[:, 2]
        self.lengths = np.add.reduceat(self.raw[:-1], self.first[:-1]) // 4 if docs else np.zeros(0, np.int64)
        self.unpack = zstandard.ZstdDecompressor()

    def frames(self, i: int) -> Iterator[bytes]:
        """The raw bytes of document number i, frame by frame."""
        for k in range(self.first[i], self.first[i + 1]):
            raw = self.unpack.decompress(self.file.read_at(int(self.sizes[k]), int(self.starts[k])), int(self.raw[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
                raise ValueError(f"frame {k} is damaged")
            yield raw

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.frames(i)), "<u4")


def _digests(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in rows:
        for path, offset in zip(files["path"], files["start"]):
            file = Reader(path)
            checks = np.zeros(len(file.doc_ids), dtype=np.int64)
            for i in range(len(checks)):
                crc = 0
                for raw in file.frames(i):
                    crc = zlib.crc32(raw, crc)
                checks[i] = crc
            yield pd.DataFrame({
                "doc_id": pd.array(file.doc_ids, dtype="Int64"), "start": offset + np.cumsum(file.lengths) - file.lengths,
                "n_tokens": file.lengths, "ids_crc32": checks,
            }).assign(doc_id=lambda x: x.doc_id.mask(file.nulls))


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of every document, from the files' frames.

    files is what write_ids returns. The running sum is over files: one row each.
    """
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("bucket", "path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    number = max(1, files.count())
    return placed.repartition(number, "bucket").mapInPandas(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all documents to a new shared folder and read them back."""
    return read_digests(write_ids(docs, new_dir(docs.sparkSession, "tokens"), tokenizer))
