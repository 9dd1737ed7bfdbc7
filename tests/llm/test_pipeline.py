import random
from collections import Counter, defaultdict

import pytest
from conftest_llm import edge_rows, random_texts
from test_neardup import brute

import corpus_pipeline
from seriesweave.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, make_docs):
    rng, rows, labels = random.Random(0), [], []
    for i, text in enumerate(random_texts(400, seed=21, words=150, vocabulary=3000)):
        toxic = i % 6 == 0
        if toxic:
            text += " you zorgon zorgon blatfink"
        rows.append((i, text + "\nfooter of the site", "en", f"s{i % 3}", len(text)))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, ("x " if rng.random() < 0.5 else "") + rows[i * 6 + 1][1], "en", "s1", 0) for i in range(40)]
    rows += [(2000 + (r[0] or 0), *r[1:]) for r in edge_rows()]
    folder = str(tmp_path_factory.mktemp("tables"))
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, dict(labels)


def test_stages(spark, tables, tmp_path):
    folder, rows, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    first = {r.doc_id for r in kept["toxicity"]}
    assert not first & {d for d, t in toxic.items() if t} and first >= {d for d, t in toxic.items() if not t}
    second = {r.doc_id: r.text for r in kept["line_dedup"]}
    assert second.keys() == first and not any("footer of the site" in (t or "") for t in second.values())
    third = {r.doc_id for r in kept["minhash_near_dedup"]}
    assert third == {d for d, _, first_id in brute(list(second.items()), 5) if d == first_id} and third < first
    fourth = Counter(r.doc_id for r in kept["source_mixing"])
    assert fourth.keys() <= third and max(fourth.values()) <= 3 and len(fourth) < len(third)
    pieces, held = defaultdict(int), Counter()
    for r in kept["best_fit_packing"]:
        pieces[r.sequence_id] += r.length
        held[r.sequence_id] += 1
    assert max(held.values()) <= corpus_pipeline.MOST_PIECES
    assert {r.doc_id for r in kept["best_fit_packing"]} == set(fourth) and max(pieces.values()) <= 4096
    assert sum(r.piece == 0 for r in kept["best_fit_packing"]) == sum(fourth.values())
    whole = corpus_pipeline.run(spark, folder).drop("sequence_id", "offset")
    assert sorted(map(str, whole.collect())) == sorted(str(r) for r in docs.drop("sequence_id", "offset").collect())


def test_empty_tables(spark, tmp_path, no_docs):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and ORACLE.keys() <= QUERIES.keys()
