"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesweave.llm import binary, fingerprints, lines, mixing, neardup, packing, prefixtrie, repair, secrets, sharding, topk, toxicity, urls
from seriesweave.llm.tables import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's site is its source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of two words."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), size=2, percent=80)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited text: its second half gives way to the beginning of the next document."""
    return fingerprints.edited(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only texts and ids reach the operator.
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    doc_id = F.col("row.doc_id")
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return out.select(doc_id, toxicity.held_out(doc_id).alias("held_out"), "score", predicted.alias("predicted"), "evidence")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of shards are near equal."""
    out = sharding.shard(read(spark, sf_dir, "documents"))
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.token_files(read(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.family_trie(read(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_best_fit_packing, op3_line_dedup, op4_url_filter, op5_top_k, op6_near_duplicates, op7_fingerprints, op8_toxicity,
        op9_sharding, op10_token_files, op11_secret_scan, op12_prefix_trie, op13_structure_repair,
    )
}

ORACLE = {
    "op3_line_dedup": """
WITH line AS (
    SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), own AS (
    SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) AS line
    FROM line
), common AS (
    SELECT o.source, o.line
    FROM (SELECT source, line, count(*) AS n FROM own GROUP BY ALL) AS o
    JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) AS s ON o.source IS NOT DISTINCT FROM s.source
    WHERE n >= 3 AND n > 0.1::DOUBLE * pages
), per_site AS (
    SELECT source, list(line) AS drops FROM common GROUP BY source
), kept AS (
    SELECT l.*, list_filter(lines, lambda x: drops IS NULL OR NOT list_contains(drops, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS rest
    FROM line AS l LEFT JOIN per_site AS p ON l.source IS NOT DISTINCT FROM p.source
), whole AS (
    SELECT *, CASE WHEN len(list_filter(rest, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '')) > 0 THEN rest ELSE lines END AS stay
    FROM kept
)
SELECT doc_id, source, array_to_string(stay, chr(10)) AS text,
    CAST(coalesce(len(lines), 0) AS INTEGER) AS lines_total, CAST(coalesce(len(lines) - len(stay), 0) AS INTEGER) AS lines_dropped
FROM whole
""",
}
