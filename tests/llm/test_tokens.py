import zlib

import numpy as np
import pytest
from conftest_llm import edge_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesweave.llm import binary, packing
from seriesweave.llm.tables import new_dir
from seriesweave.llm.tokens import Encoder, default_tokenizer


@pytest.fixture(scope="module")
def encoders():
    return Encoder(default_tokenizer()), Encoder(default_tokenizer(), keep=300)


def whole(encoder, texts):
    return [x.ids for x in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ALPHABET = "aAbBzéÉßİſςΣ中.,;:!?'\"<|>0 1-\t\n\x0b\x0c\r\x1c\x85\xa0 ́क़"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=30)), max_size=30))
def test_ids_of_words_are_ids_of_texts(encoders, texts):
    for encoder in encoders:
        assert [x.tolist() for x in encoder(texts)] == whole(encoder, texts)


def test_special_tokens_and_nulls(encoders):
    texts = [None, "", "x<|endoftext|>y", "<|STARTOFTEXT|> <|startoftext|>.", "don't we'LL it's", "a. b.. c", "Ab, ab ,ab"]
    assert [x.tolist() for x in encoders[0](texts)] == whole(encoders[0], texts)


def expected(encoder, docs):
    return [(d, ids + [1]) for (d, _), ids in zip(docs, whole(encoder, [t for _, t in docs]))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_round_trip(spark, edge_docs, encoders):
    folder = new_dir(spark, "round")
    files = binary.write_ids(edge_docs, folder, docs_per_file=3)
    got = [r[:] for r in binary.read_digests(files).collect()]
    docs = sorted(edge_texts(), key=lambda r: (r[0] is None, r[0] or 0))
    want = expected(encoders[0], docs)
    assert sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in got) == sorted((d is None, d or 0, len(i), crc(i)) for d, i in want)
    in_order = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in in_order] == [d for d, _ in docs]
    assert [r[1] for r in in_order] == np.cumsum([0] + [r[2] for r in in_order])[:-1].tolist()
    path = files.orderBy("bucket").first().path
    reader = binary.Reader(path)
    assert crc(reader.ids(0).tolist()) == in_order[0][3]


def test_long_documents_have_several_frames_and_damage_is_seen(spark, make_docs, monkeypatch):
    monkeypatch.setattr(binary, "FRAME_IDS", 7)
    run = binary._frames(default_tokenizer(), 1, [])
    import pyarrow as pa

    rows = list(run(iter([pa.RecordBatch.from_arrays([pa.array([5]), pa.array(["word " * 20])], names=["doc_id", "text"])])))
    assert rows[0]["part"].to_pylist() == [0, 1, 2] and rows[0]["ids"].to_pylist() == [7, 7, 7]
    files = binary.write_ids(make_docs([(1, "some text"), (2, "more")]), new_dir(spark, "damaged"))
    path = files.first().path
    name = path.removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[8] ^= 0xFF
    open(name, "wb").write(data)
    with pytest.raises(Exception):
        binary.Reader(path).ids(0)


def test_no_documents(no_docs):
    assert binary.token_files(no_docs).collect() == []
    assert packing.packed(no_docs).collect() == []


def check_packing(rows, want, length):
    pieces = {}
    for d, ids in want:
        for piece, start in enumerate(range(0, len(ids), length)):
            part = ids[start : start + length]
            key = (d, piece, start, len(part), crc(part))
            pieces[key] = pieces.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences)


def test_packing_edges(edge_docs, encoders):
    rows = packing.packed(edge_docs, length=50).collect()
    want = expected(encoders[0], edge_texts())
    n = check_packing(rows, want, 50)
    assert n <= -(-sum(len(i) for _, i in want) // 50) + 1


def test_packing_keeps_every_capacity():
    rng = np.random.default_rng(0)
    lengths = -np.sort(-rng.integers(1, 60, 400))
    for score in ("norm", "dot"):
        bins, offsets = packing.best_fit(lengths, 100, 3, 4000, (1.0, 0.1, 0.1), score)
        for b in np.unique(bins):
            own = lengths[bins == b]
            assert own.sum() <= 100 and len(own) <= 3 and (own**2).sum() <= 4000
            assert sorted(offsets[bins == b]) == sorted(np.cumsum(own) - own)


def test_one_part_is_near_the_bound():
    lengths = -np.sort(-np.random.default_rng(1).integers(1, 3000, 3000))
    bins, _ = packing.best_fit(lengths, 4096, 4096, 4096**2, (1.0, 0.01, 0.01), "norm")
    assert len(np.unique(bins)) <= np.ceil(lengths.sum() / 4096) * 1.01 + 1


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_binds_on_a_table(spark, score):
    """Against a plain best fit; without any one of the capacities the result is another."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(np.concatenate([rng.integers(1, 40, 300), rng.integers(300, 1000, 200)]))]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    limits, weights = (4096, 12, 3_000_000), (1.0, 0.5, 0.5)

    def plain(tokens, most, cost):
        bins = []
        for doc_id, _, _, n, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
            need, best = (n, 1, n * n), None
            for room, held in bins:
                if all(r >= x for r, x in zip(room, need)):
                    scaled = [((r - x) / c, r * x / c**2) for r, x, c in zip(room, need, (tokens, most, cost))]
                    value = sum(w * a * a for w, (a, _) in zip(weights, scaled)) if score == "norm" else -sum(w * b for w, (_, b) in zip(weights, scaled))
                    if best is None or value < best[0] - 1e-12:
                        best = value, room, held
            if best is None:
                bins.append(([tokens, most, cost], []))
                best = 0, *bins[-1]
            best[1][:] = [r - x for r, x in zip(best[1], need)]
            best[2].append(doc_id)
        return bins

    def got(tokens, most, cost):
        found = {}
        for r in packing.pack(pieces, len(rows), tokens, most, cost, weights, score).collect():
            found.setdefault(r.sequence_id, []).append(r)
        return list(found.values())

    found = got(*limits)
    for held in found:
        lengths = [r.length for r in held]
        assert sum(lengths) <= 4096 and len(held) <= 12 and sum(n * n for n in lengths) <= 3_000_000
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert sum(len(held) for held in found) == len(rows)
    want = plain(*limits)
    assert abs(len(found) - len(want)) <= 1
    for loose in ((10**6, 12, 3_000_000), (4096, 10**6, 3_000_000), (4096, 12, 10**9)):
        assert sorted(map(len, got(*loose))) != sorted(map(len, found))


def test_memory_goes_back_after_every_batch(monkeypatch):
    """A worker tokenizes many batches: what one of them took must not add up to the end of its task."""
    import pyarrow as pa

    from seriesweave.llm import words

    given = []
    monkeypatch.setattr(words, "give_back", lambda: given.append(len(asked)))
    asked, taken = [], []
    monkeypatch.setattr(packing, "ROWS", 2)
    monkeypatch.setattr(packing, "encoder", lambda path: lambda texts: taken.append(texts) or [np.array([len(t or "")], np.uint32) for t in texts])

    def batches():
        for i in range(3):
            asked.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([i, None, i]), pa.array(["a" * i, None, "bb"])], names=["doc_id", "text"])

    rows = [r for b in packing._pieces("", 4096, 1, False)(batches()) for r in b.to_pylist()]
    assert [(r["doc_id"], r["length"], r["ids_crc32"]) for r in rows] == [x for i in range(3) for x in ((i, 2, crc([i, 1])), (None, 2, crc([0, 1])), (i, 2, crc([2, 1])))]
    assert taken == [x for i in range(3) for x in (["a" * i, None], ["bb"])]
    assert given == [1, 2, 3, 3]


def test_odd_words_are_encoded_a_few_at_a_time(encoders):
    """Answers of the library are large: a text of many numbers must not have all of its at once."""
    sizes, own = [], encoders[0].tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **kw):
            sizes.append(len(texts))
            return own.encode_batch_fast(texts, **kw)

        def __getattr__(self, name):
            return getattr(own, name)

    text = " ".join(f"{i}-{i * 7}" for i in range(5000))
    encoder = Encoder(default_tokenizer())
    encoder.tokenizer = Counting()
    assert encoder([text])[0].tolist() == whole(encoders[0], [text])[0] and 0 < max(sizes) <= 1000
    assert [x.tolist() for x in encoder._encode([])] == [[], []]


def test_a_full_cache_loses_only_words_that_were_not_met_again(encoders):
    """Common words are asked for once, however many rare ones pass; the ids stay those of the whole texts."""
    common = ["alpha", "beta", "gamma", "delta"]
    texts = [" ".join(common + [f"w{i}x{j}" for j in range(40)]) for i in range(30)]
    encoder, asked = Encoder(default_tokenizer(), keep=300), []
    letters = encoder._letters
    encoder._letters = lambda spans: asked.extend(spans) or letters(spans)
    got = [encoder([text])[0].tolist() for text in texts]
    assert got == [x.tolist() for x in encoders[0](texts)] == [whole(encoders[0], [text])[0] for text in texts]
    assert sorted(asked) == sorted(common) and encoder.count <= 300
    rare = [encoder([text])[0].tolist() for text in texts]  # gone in the meantime, so asked for anew
    assert rare == got


def test_an_encoder_is_small(encoders):
    """A worker keeps its encoder while it is idle, beside the JVM."""
    encoder = Encoder(default_tokenizer())
    arrays = lambda: sum(x.nbytes for x in vars(encoder).values() if isinstance(x, np.ndarray))
    assert arrays() < 16 << 20
    n = encoder.keep - 1
    encoder._add(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.full(n, 4), np.zeros(4 * n, np.uint32))
    assert arrays() < 32 << 20


def test_forgotten_encoders_give_their_memory_back(monkeypatch):
    from seriesweave.llm import tokens

    given = []
    monkeypatch.setattr(tokens, "give_back", lambda: given.append(tokens.encoder.cache_info().currsize))
    tokens.encoder(default_tokenizer())
    tokens.release()
    tokens.release()  # nothing left
    assert given == [0]


def test_tokenizing_is_handed_a_megabyte_at_once(spark, edge_docs):
    from seriesweave.llm.tables import BATCH, size_in_bytes

    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "64m")
        packing.token_pieces(edge_docs)
        assert size_in_bytes(spark.conf.get(BATCH)) <= 1 << 20
    finally:
        spark.conf.set(BATCH, before)
