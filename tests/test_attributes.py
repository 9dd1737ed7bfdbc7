from pyspark.sql import functions as F

from seriesweave.catalog import fixtures as fx
from seriesweave.operators.attributes import compare_attributes


def _entities(spark, *rows):
    made = spark.createDataFrame([tuple(r) for r in rows], "site string, entity_id string, json string")
    return made.select("site", "entity_id", F.parse_json("json").alias("attrs"))


def _broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_entities_of_a_small_file_are_not_broadcast(spark, tmp_path):
    """A stored table's size tells nothing about the entities made of it."""
    rows = [(f"s{i % 3}", f"e{i}", f'{{"a":{{"b":{i % 2}}},"c":null}}') for i in range(40)]
    spark.createDataFrame(rows, "site string, entity_id string, json string").write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([(f"e{i}", f"e{i + 3}") for i in range(0, 37)], "old_id string, new_id string").write.parquet(f"{tmp_path}/p")
    entities = spark.read.parquet(f"{tmp_path}/e").select("site", "entity_id", F.parse_json("json").alias("attrs"))
    found = compare_attributes(entities, spark.read.parquet(f"{tmp_path}/p"))
    assert _broadcasts(found) == 0
    assert {(r.path, r.diff) for r in found.collect()} == {("a/b", "different")}


def test_pairs_at_all_sites_and_at_their_own(spark):
    entities = _entities(
        spark, ("s", "x", '{"a":1}'), ("s", "y", '{"a":1.0,"b":"t"}'), ("t", "x", '{"a":2}'), (None, "x", '{"a":3}'), ("u", "z", '{"a":4}')
    )
    pairs = spark.createDataFrame([("x", "y"), ("x", "y"), (None, "z"), ("x", "x")], "old_id string, new_id string")
    row = lambda r: (r.site, r.old_id, r.new_id, r.path, r.old_value, r.new_value, r.diff)
    at_all = sorted(map(row, compare_attributes(entities, pairs).collect()), key=str)
    assert at_all == sorted(
        [
            ("s", "x", "y", "a", "1", "1", "same"),
            ("s", "x", "y", "b", None, "t", "only_new"),
            ("s", "x", "x", "a", "1", "1", "same"),
            ("t", "x", "y", "a", "2", None, "only_old"),
            ("t", "x", "x", "a", "2", "2", "same"),
            ("u", None, "z", "a", None, "4", "only_new"),
        ],
        key=str,
    )
    own = pairs.select(F.lit("s").alias("site"), "*")
    assert {row(r) for r in compare_attributes(entities, own).collect()} == {r for r in at_all if r[0] == "s"}


def test_documents_are_spread_before_they_are_made(spark, tmp_path):
    customers = [(i, f"C{i}", i % 25, 1.0, "BUILDING") for i in range(100)]
    columns = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(customers, columns).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    documents = fx.registry_documents(spark, str(tmp_path))
    assert documents.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
