"""Timestamps as texts and as epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_COMPACT = r"^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2})(\d{2})"
_HAS_ZONE = r"(?:[zZ]|[+-]\d{2}(?::?\d{2})?)$"
_ZONED = (
    r"^\d{4}-?\d{2}-?\d{2}[T ]\d{2}:?\d{2}(?::?\d{2}(?:[.,]\d{1,6})?)?"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)$"
)


def _iso(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), _COMPACT, "$1-$2-$3T$4:$5:$6")


def _micros(stamp: Column) -> Column:
    return F.unix_micros(stamp) / F.lit(1e6)


def _naive_seconds(text: Column) -> Column:
    """Whole seconds since 1970 of a text read as UTC, whatever the session zone."""
    return F.timestamp_diff(
        "SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), text.try_cast("timestamp_ntz")
    ).cast("double")


def text_epoch(text: Column, zone: str | None = None) -> Column:
    """ISO text to epoch seconds; text without a zone is in the named zone, else in the session's.

    A local time that the clocks pass twice in autumn is the first of the two.
    """
    iso = _iso(text)
    zoned = _micros(iso.try_cast("timestamp"))
    if zone is None:
        return zoned
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), iso.try_cast("timestamp_ntz"))
    naive = F.timestamp_diff("MICROSECOND", start, utc) / F.lit(1e6)
    return F.when(iso.rlike(r"\d{2}:\d{2}.*" + _HAS_ZONE), zoned).otherwise(naive)


def text_epoch_utc(text: Column) -> Column:
    """ISO text to whole epoch seconds; text without a zone is UTC."""
    iso = _iso(text)
    zoned = F.floor(_micros(iso.try_cast("timestamp"))).cast("double")
    return F.when(iso.rlike(r"\d{2}:\d{2}.*" + _HAS_ZONE), zoned).otherwise(_naive_seconds(iso))


def reset_epoch(text: Column) -> Column:
    """Epoch seconds of a reset mark from its first 19 characters, zone ignored."""
    return _naive_seconds(F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")))


def reset_instant(text: Column) -> Column:
    """Instant (epoch seconds) of a reset mark; NULL for text without a zone."""
    iso = F.trim(text)
    return F.when(iso.rlike(_ZONED), _micros(_iso(iso).try_cast("timestamp")))


def local_time(ts: Column) -> Column:
    """Epoch seconds as local ``yyyy-MM-dd HH:mm:ss``, for display."""
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss")
