"""Entity registries: JSON documents in, one row per entity out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.variants import text_field


def read_documents(spark: SparkSession, path: str, site: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """``documents(site, doc)``, one row per registry file below ``path``.

    Files are spread over tasks; a JSON document itself cannot be split. The site
    is the directory a file lies in unless another pattern is given.
    """
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), site, 1).alias("site"), F.col("value").alias("doc")
    )


def document_errors(documents: DataFrame) -> DataFrame:
    """``(site, error)`` for documents that are not a registry."""
    kind = lambda path: F.schema_of_variant(F.try_variant_get("root", path, "variant"))
    missing = lambda k, wanted: F.coalesce(~F.col(k).startswith(wanted), F.lit(True))
    return (
        documents.select("site", F.try_parse_json("doc").alias("root"))
        .select(
            "site", kind("$").alias("root"), kind("$.data").alias("data"), kind("$.data.entities").alias("entities")
        )
        .select(
            "site",
            F.when(F.col("root").isNull(), "invalid JSON")
            .when(missing("root", "OBJECT"), "root is not an object")
            .when(missing("data", "OBJECT"), "data is not an object")
            .when(missing("entities", "ARRAY"), "data.entities is not a list")
            .alias("error"),
        )
        .where("error is not null")
    )


def entities_of(documents: DataFrame) -> DataFrame:
    """``entities(site, entity_id, attrs)`` of all well-formed documents.

    Entries that are no objects or have no non-empty text id are skipped; of
    several entries with one id the last in the document counts.
    """
    listed = F.try_variant_get(F.try_parse_json("doc"), "$.data.entities", "array<variant>")
    # Only objects have an id to find.
    entries = (
        documents.select("site", F.posexplode(listed).alias("pos", "attrs"))
        .select("site", "pos", text_field(F.col("attrs"), "$.entity_id").alias("entity_id"), "attrs")
        .where("entity_id is not null")
    )
    # VARIANT cannot be aggregated with an order, so carry it as text.
    return (
        entries.groupBy("site", "entity_id")
        .agg(F.max_by(F.to_json("attrs"), "pos").alias("json"))
        .select("site", "entity_id", F.parse_json("json").alias("attrs"))
    )


def entity(entities: DataFrame, entity_id: str) -> DataFrame:
    """The row of one entity."""
    return entities.where(F.col("entity_id") == entity_id)
