"""Attributes of entities: flattening, comparing and looking at single payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.variants import (
    NULL_KIND,
    compare_key,
    is_number,
    is_object,
    nesting,
    state_class,
    value_text,
)
from ..schema import LEADING_ATTRIBUTES
from .profile import summary_paths


def depth_of(entities: DataFrame) -> int:
    """How deep the attributes nest at most."""
    return entities.agg(F.max(nesting(F.to_json("attrs")))).first()[0] or 0


def flatten(entities: DataFrame, *keys: str, depth: int | None = None) -> DataFrame:
    """``(keys, path, value)``: nested objects become ``a/b`` paths; lists and empty objects stay whole.

    Every level of nesting is one more explode in a single chain, in which values
    that are no objects pass through. How deep the data goes, at most, is looked up first
    unless it is given.
    """
    keys = list(keys or ("site", "entity_id"))
    depth = depth_of(entities) if depth is None else depth
    cells = entities.select(*keys, F.lit(None).cast("string").alias("path"), F.col("attrs").alias("value"))
    for _ in range(depth):
        fields = F.map_entries(F.try_variant_get("value", "$", "map<string,variant>"))
        below = F.transform(
            fields, lambda f: F.struct(F.concat_ws("/", "path", f["key"]).alias("path"), f["value"].alias("value"))
        )
        cell = F.explode(F.when(F.size(fields) > 0, below).otherwise(F.array(F.struct("path", "value"))))
        cells = cells.select(*keys, cell.alias("cell")).select(*keys, "cell.path", "cell.value")
    # An entity without attributes has no paths.
    return cells.where("path is not null")


def path_rank(path: Column) -> Column:
    """Position of a path's first part in the list of leading attributes, large if not in it."""
    place = F.array_position(F.array(*(F.lit(a) for a in LEADING_ATTRIBUTES)), F.split_part(path, F.lit("/"), F.lit(1)))
    return F.when(place > 0, place).otherwise(F.lit(10_000)).cast("int")


def compare_paths(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Compare the cells of two entities path by path, for all pairs at once.

    ``cells(entity_id, path, text, match)`` holds display text and comparison key,
    ``match`` NULL meaning a null value; ``pairs(old_id, new_id)``. With a column
    ``site`` in both, ids are told apart by it. The result has one row per path of
    either side with ``diff`` ``same``, ``different``, ``only_old`` or ``only_new``;
    paths that are null on both sides are left out.
    """
    site = [c for c in ("site",) if c in pairs.columns and c in cells.columns]
    return _compare_sides(_sides(pairs, *site).join(cells, [*site, "entity_id"]), *site)


def _sides(pairs: DataFrame, *site: str) -> DataFrame:
    """Two rows per pair: ``(site, old_id, new_id, side, entity_id)``."""
    return pairs.select(
        *site,
        "old_id",
        "new_id",
        F.explode(
            F.array(
                F.struct(F.lit("old").alias("side"), F.col("old_id").alias("entity_id")),
                F.struct(F.lit("new").alias("side"), F.col("new_id").alias("entity_id")),
            )
        ).alias("of"),
    ).select(*site, "old_id", "new_id", "of.side", "of.entity_id")


def _compare_sides(cells: DataFrame, *site: str) -> DataFrame:
    """``compare_paths`` of ``cells(site, old_id, new_id, side, path, text, match)``."""
    cell = F.struct(F.col("match").alias("match"), F.col("text").alias("text"))
    old, new = F.col("old"), F.col("new")
    return (
        cells.groupBy(*site, "old_id", "new_id", "path")
        .agg(
            F.max(F.when(F.col("side") == "old", cell)).alias("old"),
            F.max(F.when(F.col("side") == "new", cell)).alias("new"),
        )
        .where(old.isNull() | new.isNull() | old["match"].isNotNull() | new["match"].isNotNull())
        .select(
            *site,
            "old_id",
            "new_id",
            "path",
            old["text"].alias("old_value"),
            new["text"].alias("new_value"),
            F.when(new.isNull(), "only_old")
            .when(old.isNull(), "only_new")
            .when(old["match"].eqNullSafe(new["match"]), "same")
            .otherwise("different")
            .alias("diff"),
            path_rank(F.col("path")).alias("rank"),
        )
    )


def compare_attributes(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attribute differences of old and new entities, site by site; order by ``rank``, ``path`` to print them.

    ``pairs(site, old_id, new_id)``; pairs without ``site`` hold for every site that
    has one of their entities.
    """
    site = [c for c in ("site",) if c in pairs.columns]
    # Sizes are unknown before documents are parsed: a small file may hold more entities than a broadcast could.
    met = entities.where("site is not null").join(_sides(pairs, *site).hint("merge"), [*site, "entity_id"])
    # One id may be at every site. Both documents of a pair meet here, as they are; their cells stay in the task.
    partitions = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["site", "old_id", "new_id"]
    met = met.select(*keys, "side", "attrs").repartition(partitions, *keys)
    value, kind = F.col("value"), F.col("kind")
    cells = (
        flatten(met, *keys, "side", depth=depth_of(entities))
        .withColumn("kind", F.schema_of_variant("value"))
        .select(
            *keys,
            "side",
            "path",
            value_text(value, kind).alias("text"),
            F.when(kind != NULL_KIND, compare_key(value, kind)).alias("match"),
        )
    )
    return _compare_sides(cells, "site")


def compare_summaries(summary: DataFrame, pairs: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    """The same comparison of two series' summaries; series without rows count as 0 rows."""
    ids = pairs.select(F.explode(F.array("old_id", "new_id")).alias("series_id")).distinct()
    spine = ids.select("series_id", F.explode(F.array(*(F.lit(t) for t in tables))).alias("table"))
    shown = spine.join(summary, ["series_id", "table"], "left").withColumns(
        {
            "row_count": F.coalesce("row_count", F.lit(0)),
            "unavailable_count": F.coalesce("unavailable_count", F.lit(0)),
            # An empty entry still shows its two lines, as null.
            **{
                e: F.coalesce(
                    e,
                    F.struct(
                        F.lit(None).cast("double").alias("ts"),
                        F.lit(None).cast("string").alias("value"),
                        F.lit(None).cast("double").alias("sum"),
                    ),
                )
                for e in ("earliest", "latest")
            },
        }
    )
    cells = summary_paths(shown).select(
        F.col("series_id").alias("entity_id"),
        "path",
        F.coalesce("value", F.lit("null")).alias("text"),
        F.col("value").alias("match"),
    )
    return compare_paths(cells, pairs)


def state_classes(entities: DataFrame) -> DataFrame:
    """``(site, entity_id, state_class)``; NULL where an entity has none."""
    return entities.select("site", "entity_id", state_class(F.col("attrs")).alias("state_class"))


def attribute_probe(states: DataFrame, per_series: int, name: str = "last_reset") -> DataFrame:
    """The newest ``per_series`` rows of each series with one attribute of their payload.

    Read states with ``attributes="probe"``. ``kind`` is the JSON type of the
    attribute; ``problem`` tells why a payload has no attributes.
    """
    newest = Window.partitionBy("series_id").orderBy(F.desc("ts"), F.desc("row_id"))
    rows = states.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= per_series)
    rows = rows.withColumn("text", F.nullif(F.trim("attrs"), F.lit(""))).withColumn("doc", F.try_parse_json("text"))
    rows = rows.withColumn("found", F.try_variant_get("doc", f"$.{name}", "variant")).withColumns(
        {"doc_kind": F.schema_of_variant("doc"), "kind": F.schema_of_variant("found")}
    )
    kind = F.nullif(F.col("kind"), F.lit(NULL_KIND))
    word = lambda k: F.regexp_extract(k, r"^\w+", 0)
    return rows.select(
        "series_id",
        "position",
        "ts",
        "state",
        F.when(kind.isNotNull(), value_text(F.col("found"), kind)).alias(name),
        F.when(is_number(kind), "NUMBER").otherwise(word(kind)).alias("kind"),
        F.when(F.col("text").isNotNull() & F.col("doc").isNull(), "invalid JSON")
        .when(~is_object(F.col("doc_kind")), F.concat(F.lit("not an object: "), word(F.col("doc_kind"))))
        .alias("problem"),
        F.col("text").alias("payload"),
    )
