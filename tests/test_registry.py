import json

from pyspark.sql import functions as F

from seriesweave.operators import attributes
from seriesweave.sources import registry


def load(spark, tmp_path, **docs):
    for site, doc in docs.items():
        (tmp_path / site).mkdir()
        (tmp_path / site / "registry.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False))
    return registry.read_documents(spark, f"{tmp_path}/*/registry.json")


def test_load(spark, tmp_path):
    entities = [
        {"entity_id": "sensor.a", "unique_id": "u1", "aliases": ["x"]},
        {"entity_id": "sensor.b", "unique_id": "first"},
        5,
        {"entity_id": ""},
        {"entity_id": 7},
        {"name": "nameless"},
        {"entity_id": "sensor.b", "unique_id": "u2"},
    ]
    docs = load(
        spark,
        tmp_path,
        home={"data": {"entities": entities}},
        broken="{",
        listed=[],
        empty={},
        odd={"data": {"entities": {}}},
        bad_data={"data": 3},
    )
    rows = registry.entities_of(docs)
    ids = {(r.site, r.entity_id): r.u for r in rows.select("*", F.try_variant_get("attrs", "$.unique_id", "string").alias("u")).collect()}
    assert ids == {("home", "sensor.a"): "u1", ("home", "sensor.b"): "u2"}
    assert registry.entity(rows, "sensor.a").count() == 1
    errors = {r.site: r.error for r in registry.document_errors(docs).collect()}
    assert errors == {
        "broken": "invalid JSON",
        "listed": "root is not an object",
        "empty": "data is not an object",
        "odd": "data.entities is not a list",
        "bad_data": "data is not an object",
    }


def compare(spark, old, new):
    rows = [("home", "sensor.old", json.dumps(old)), ("home", "sensor.new", json.dumps(new))]
    entities = spark.createDataFrame(rows, "site string, entity_id string, json string").select(
        "site", "entity_id", F.parse_json("json").alias("attrs")
    )
    pairs = spark.createDataFrame([("sensor.old", "sensor.new")], "old_id string, new_id string")
    found = attributes.compare_attributes(entities, pairs).orderBy("rank", "path").collect()
    return {r.path: (r.old_value, r.new_value, r.diff) for r in found}


def test_compare(spark):
    old = {"options": {"b": 2, "a": 1}, "unique_id": "u", "entity_id": "sensor.old", "area_id": None, "aliases": ["a"], "z": {}, "n": 1, "t": True}
    new = {"options": {"b": 3, "a": 1}, "unique_id": "u", "entity_id": "sensor.new", "area_id": None, "aliases": ["b"], "z": {}, "n": 1.0, "t": "true"}
    rows = compare(spark, old, new)
    assert list(rows) == ["entity_id", "unique_id", "aliases", "n", "options/a", "options/b", "t", "z"]
    assert rows["entity_id"] == ("sensor.old", "sensor.new", "different")
    assert rows["unique_id"] == ("u", "u", "same")
    assert rows["aliases"] == ('["a"]', '["b"]', "different")
    assert rows["options/a"][2] == "same" and rows["options/b"] == ("2", "3", "different")
    assert rows["n"][2] == "same" and rows["t"] == ("true", "true", "different")
    assert rows["z"] == ("{}", "{}", "same")


def test_large_integers_compare_digit_by_digit(spark):
    rows = compare(spark, {"a": 9007199254740993, "b": 10**17, "c": 5}, {"a": 9007199254740992, "b": 1e17, "c": 5.0})
    assert [rows[p][2] for p in "abc"] == ["different", "same", "same"]


def test_sites_with_equal_ids_are_told_apart(spark):
    data = [(s, f"s.{e}", '{"unique_id":%d}' % u) for s, e, u in (("a", "o", 1), ("a", "n", 1), ("b", "o", 2), ("b", "n", 3))]
    entities = spark.createDataFrame(data, "site string, entity_id string, j string")
    entities = entities.select("site", "entity_id", F.parse_json("j").alias("attrs"))
    pairs = spark.createDataFrame([("s.o", "s.n")], "old_id string, new_id string")
    got = sorted((r.site, r.diff) for r in attributes.compare_attributes(entities, pairs).collect())
    assert got == [("a", "same"), ("b", "different")]


def test_one_sided(spark):
    rows = compare(spark, {"unique_id": "u", "a": {"b": {"c": None}}}, {"entity_id": "sensor.new", "a": {"b": {}}})
    assert rows["unique_id"] == ("u", None, "only_old")
    assert rows["entity_id"] == (None, "sensor.new", "only_new")
    assert rows["a/b/c"] == ("null", None, "only_old")
    assert rows["a/b"] == (None, "{}", "only_new")


def test_deep_and_flat(spark):
    deep = {"k0": 1}
    for i in range(1, 12):
        deep = {f"k{i}": deep}
    assert "/".join(f"k{i}" for i in range(11, -1, -1)) in compare(spark, deep, {})
    assert compare(spark, {}, {}) == {}


def test_probe(states):
    rows = states(
        ("a", 1, "1", '{"last_reset":"2025-01-01"}'),
        ("a", 2, "2", "{bad"),
        ("a", 3, "3", "[1]"),
        ("a", 4, "4", '{"last_reset":5}'),
        ("a", 5, "5", None),
        ("a", 6, "6", '{"last_reset":null,"x":"%s"}' % ("y" * 300)),
    )
    got = {r.ts: r for r in attributes.attribute_probe(rows, per_series=5).collect()}
    assert set(got) == {2.0, 3.0, 4.0, 5.0, 6.0}
    assert got[2.0].problem == "invalid JSON" and got[3.0].problem == "not an object: ARRAY"
    assert (got[4.0].last_reset, got[4.0].kind) == ("5", "NUMBER")
    assert (got[5.0].last_reset, got[5.0].problem) == (None, None)
    assert got[6.0].last_reset is None and len(got[6.0].payload) > 300
    full = attributes.attribute_probe(rows, per_series=9).where("ts = 1").first()
    assert (full.last_reset, full.kind) == ("2025-01-01", "STRING")
