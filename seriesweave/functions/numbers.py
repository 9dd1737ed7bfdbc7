"""Numbers out of state texts, and the arithmetic on neighbouring readings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import GAP_FACTOR, RESET_RATIO

# Number at the start of a text; what follows it is ignored.
_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
# Complete number, including the words for infinity and not-a-number.
_WHOLE_NUMBER = r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity|nan)$"


# White space that may stand around a number.
_BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _plain_number(text: Column) -> Column:
    """Fast path without patterns for texts that end in a digit and are not hexadecimal."""
    decimal = F.substring(text, -1, 1).between("0", "9") & ~text.contains("x") & ~text.contains("X")
    return F.when(decimal, text.try_cast("double"))


def leading_number(text: str | Column) -> Column:
    """Number at the start of a text, 0.0 if there is none: ``'12abc'`` is 12."""
    text = F.col(text) if isinstance(text, str) else text
    prefix = F.nullif(F.regexp_extract(text, _LEADING_NUMBER, 1), F.lit(""))
    return F.coalesce(_plain_number(text), prefix.try_cast("double"), F.lit(0.0))


def whole_number(text: str | Column) -> Column:
    """The text as a number, NULL unless all of it is one."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.btrim(text, F.lit(_BLANK)), r"(?<=\d)_(?=\d)", "")
    return F.coalesce(
        _plain_number(text),
        F.when(bare.rlike(_WHOLE_NUMBER), bare.try_cast("double")),
    )


def bucket(ts: str | Column, interval: int | Column) -> Column:
    """Start of the bucket a time falls in, truncated towards zero."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    interval = F.lit(interval).cast("bigint") if isinstance(interval, int) else interval
    return (ts / interval).cast("bigint") * interval


def missing_rows(before_ts: Column, after_ts: Column, interval: Column) -> Column:
    """Rows missing between two neighbours; NULL when they are close enough."""
    delta = after_ts - before_ts
    return F.when(
        delta > interval * F.lit(GAP_FACTOR),
        F.bround(delta / interval).cast("bigint") - 1,
    )


def falls(current: Column, previous: Column, mode: Column) -> Column:
    """Counter reset test; a NaN on either side is never a reset."""
    limit = F.when(mode == "total_increasing", previous * RESET_RATIO).otherwise(previous)
    return previous.isNotNull() & ~F.isnan(previous) & (current < limit)


def counted_delta(
    value: Column, previous: Column, reset: Column, previous_reset: Column, kind: Column
) -> Column:
    """What a reading adds to the running sum, given the reading before it.

    A fall adds nothing. For kind ``total`` a reset mark that differs from the
    previous row's mark means that counting began again, so the whole reading
    counts (unless it is negative).
    """
    restarted = (kind == "total") & reset.isNotNull() & previous_reset.isNotNull() & (reset != previous_reset)
    return F.when(restarted, F.greatest(value, F.lit(0.0))).otherwise(
        F.greatest(value - previous, F.lit(0.0))
    )
