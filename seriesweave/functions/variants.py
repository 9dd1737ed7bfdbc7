"""JSON attributes: paths, kinds of values, texts and comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def json_field(payload: Column, name: str) -> Column:
    """One top-level field of a JSON text; NULL for malformed JSON."""
    return F.get_json_object(payload, f"$.{name}")


# What ``schema_of_variant`` calls a JSON null. The functions below take such a
# kind along with the value, as finding it out is not free.
NULL_KIND = "VOID"


def is_object(kind: Column) -> Column:
    return kind.startswith("OBJECT")


def is_number(kind: Column) -> Column:
    return (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")


def value_text(value: Column, kind: Column) -> Column:
    """Strings as they are, everything else as compact JSON with sorted keys."""
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def compare_key(value: Column, kind: Column) -> Column:
    """Text that is equal for equal values: numbers by value, the rest by JSON.

    Numbers that a double may not hold exactly are compared digit by digit, decimals with
    their places.
    """
    number = F.try_variant_get(value, "$", "double")
    whole = F.try_variant_get(value, "$", "decimal(38,0)").cast("string")
    places = F.regexp_replace(F.regexp_replace(F.to_json(value), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    digits = F.when(F.abs(number) >= 2.0**53, F.when(kind.startswith("DECIMAL"), places).otherwise(whole))
    return F.when(is_number(kind), F.coalesce(digits, number.cast("string"))).otherwise(F.to_json(value))


def text_field(attrs: Column, path: str) -> Column:
    """Non-empty string at a path; NULL for any other kind of value."""
    found = F.try_variant_get(attrs, path, "variant")
    return F.when(
        F.schema_of_variant(found) == "STRING",
        F.nullif(F.try_variant_get(found, "$", "string"), F.lit("")),
    )


def state_class(attrs: Column) -> Column:
    """Class of a sensor: from its capabilities, else its own or original class."""
    return F.coalesce(
        text_field(attrs, "$.capabilities.state_class"),
        text_field(attrs, "$.state_class"),
        text_field(attrs, "$.original_state_class"),
    )


def nesting(json: Column) -> Column:
    """How deep brackets nest in a JSON text, ignoring those inside strings."""
    # Escapes go first: a pattern for strings with escapes overflows the stack on long ones.
    bare = F.regexp_replace(json, r"\\.", "")
    brackets = F.regexp_replace(bare, r'"[^"]*"|[^"{}\[\]]+', "")
    steps = F.split(brackets, "")
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, c: F.struct(
            (acc["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("now"),
            F.greatest(acc["top"], acc["now"] + F.when(c.isin("{", "["), 1).otherwise(0)).alias("top"),
        ),
    )
    return walk["top"]
