"""Texts for reports. Operators return typed columns; these render them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .times import local_time


def number_text(x: Column) -> Column:
    """A double with at least one decimal and no exponent between 1e-4 and 1e16."""
    text = x.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(?<=\d)0+$", "")
    size = F.abs(x)
    return F.when((F.instr(text, "E") > 0) & (size >= 1e-4) & (size < 1e16), plain).otherwise(text)


def value_with_sum(value: Column, total: Column) -> Column:
    """``value (sum)``, or only the value where there is no sum."""
    return F.when(total.isNull(), value).otherwise(F.concat(value, F.lit(" ("), total, F.lit(")")))


def delta_text(delta: Column) -> Column:
    """Signed difference with up to six decimals."""
    digits = F.regexp_replace(
        F.regexp_replace(F.format_string("%.6f", F.abs(delta)), "0+$", ""), r"\.$", ""
    )
    return F.concat(F.when(delta >= 0, "+").otherwise("-"), digits)


def change_text(old: Column, new: Column, delta: Column) -> Column:
    """``old -> new (+delta)`` from two texts; ``(none)`` stands for a missing side."""
    none = F.lit("(none)")
    base = F.concat(F.coalesce(old, none), F.lit(" -> "), F.coalesce(new, none))
    return F.when(delta.isNull(), base).otherwise(F.concat(base, F.lit(" ("), delta_text(delta), F.lit(")")))


def span_text(first: Column, last: Column, count: Column) -> Column:
    """One time for a single row, ``from - to`` for a run."""
    return F.when(count <= 1, local_time(first)).otherwise(
        F.concat(local_time(first), F.lit(" - "), local_time(last))
    )


def gap_text() -> Column:
    """Two lines for a row of ``missing_rows``: the times, then the values around it."""

    def pair(side: str) -> Column:
        null = F.lit("NULL")
        return F.concat(
            F.coalesce(number_text(F.col(f"{side}_state")), null),
            F.lit("/"),
            F.coalesce(number_text(F.col(f"{side}_sum")), null),
        )

    return F.concat(
        local_time(F.col("before_ts")),
        F.lit(" - "),
        local_time(F.col("after_ts")),
        F.lit(" ["),
        F.col("missing").cast("string"),
        F.lit(" rows]\n"),
        pair("before"),
        F.lit(" - "),
        pair("after"),
    )


def reset_text() -> Column:
    """Two lines for a reset event: the times, then the values around it."""
    blank = F.lit("")
    return F.concat(
        F.coalesce(local_time(F.col("before_ts")), blank),
        F.lit(" - "),
        F.coalesce(local_time(F.col("after_ts")), blank),
        F.lit("\n"),
        F.coalesce(F.col("before_value"), blank),
        F.lit(" - "),
        F.col("after_value"),
    )
