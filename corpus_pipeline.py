"""The corpus pipeline: documents in, packed training sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again before the next stage. All but the last return
the columns of documents, with n_chars of the text as the stage leaves it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesweave.llm import lines, mixing, neardup, packing, toxicity
from seriesweave.llm.tables import read, written

#: Pieces that one training sequence may hold, and the weights of tokens, pieces and attention cost in the choice.
MOST_PIECES = 32
WEIGHTS = (1.0, 0.25, 0.01)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says toxic go (operator 8)."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go (operator 3)."""
    cleaned = lines.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, similarity 0.8 (operator 6)."""
    return neardup.keep_one(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sources weighing 1, 2, 3 in turn (operator 1)."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, packed into sequences of at most 4096 ids and 32 pieces (operator 2).

    A repeated document has its pieces again. The attention cost has its weight in the choice; its
    capacity is one full piece's, as that is the least that takes every piece.
    """
    return packing.pack(packing.token_pieces(docs), docs.count(), most_pieces=MOST_PIECES, weights=WEIGHTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Fitted scores, rounding and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
