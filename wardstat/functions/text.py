"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstat.functions._util import col_of

# Leading/trailing Unicode whitespace, as Python's str.strip() removes it.
_EDGE_SPACE = r"(?U)^\s+|\s+$"
# Runs of letters and runs of non-letters: a word starts after any non-letter.
_RUNS = r"(\p{L}+|\P{L}+)"


def strip_title(c) -> Column:
    """``str.strip().title()`` — upper-case the first letter of every letter run.

    ``initcap`` only capitalises after whitespace; here ``central-delhi`` becomes
    ``Central-Delhi`` and ``3rd`` becomes ``3Rd``, and tabs/newlines are stripped.
    Null stays null.
    """
    s = F.lower(F.regexp_replace(col_of(c), _EDGE_SPACE, ""))
    runs = F.regexp_extract_all(s, F.lit(_RUNS), 1)
    return F.array_join(
        F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))),
        "",
    )


def as_text(c) -> Column:
    """R2: cast to text."""
    return col_of(c).cast("string")


def district_from_slug(c) -> Column:
    """``central-delhi`` -> ``Central Delhi``."""
    return strip_title(F.regexp_replace(col_of(c), "-", " "))


def upper_name(c) -> Column:
    """Upper case (model names in notes and charts)."""
    return F.upper(col_of(c))


def has_substring(c, needle: str) -> Column:
    """Substring test."""
    return col_of(c).contains(needle)
