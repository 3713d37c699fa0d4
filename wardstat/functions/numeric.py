"""Numeric and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions._util import col_of


def round_to(c, n: int) -> Column:
    """R16."""
    return F.round(col_of(c), n)


def clamp(c, lo=None, hi=None) -> Column:
    """``min(max(x, lo), hi)``. Null input stays null (``least``/``greatest``
    would skip the null and return the bound, T13)."""
    x = col_of(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def abs_error(actual, predicted) -> Column:
    """R18 building block: ``|actual - predicted|``."""
    return F.abs(col_of(actual) - col_of(predicted))


def trunc_int(c) -> Column:
    """``int(x)`` for non-negative x."""
    return F.floor(col_of(c)).cast("int")


def pct1(p) -> Column:
    """Share as a percentage with one decimal."""
    return F.round(col_of(p) * 100.0, 1)


def fallback(c, default) -> Column:
    """Value, or the default when missing."""
    return F.coalesce(col_of(c), F.lit(default) if not isinstance(default, Column) else default)


def risk_colour(level) -> Column:
    """High red, Medium orange, otherwise green."""
    lv = col_of(level)
    (h, hc), (m, mc), (_, lc) = K.RISK_COLOURS
    return F.when(lv == h, hc).when(lv == m, mc).otherwise(lc)
