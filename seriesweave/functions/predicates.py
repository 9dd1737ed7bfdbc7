"""Row predicates: which rows hold a reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import MARKS, UNAVAILABLE_TEXTS, VALUE_COLUMNS


def state_unavailable(state: str | Column = "state") -> Column:
    """True for NULL, blank and the texts that stand for "no reading"; never NULL."""
    state = F.col(state) if isinstance(state, str) else state
    return F.lower(F.trim(F.coalesce(state, F.lit("")))).isin("", *UNAVAILABLE_TEXTS)


def state_available(state: str | Column = "state") -> Column:
    return ~state_unavailable(state)


def statistics_unavailable() -> Column:
    """True when a statistics row holds no value at all."""
    return F.coalesce(*VALUE_COLUMNS).isNull()


def statistics_available() -> Column:
    return F.coalesce(*VALUE_COLUMNS).isNotNull()


def text_marks(statistics: DataFrame, last_reset_as: str | None = None) -> Column:
    """True for rows whose table keeps reset marks as text: as told, else by the rows' own layout, else epochs."""
    if last_reset_as is not None:
        return F.lit(last_reset_as == "text")
    return F.col(MARKS) == "text" if MARKS in statistics.columns else F.lit(False)
