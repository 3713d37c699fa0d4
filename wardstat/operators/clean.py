"""Cleaning: headers, parsing, labels, fills, dedup.

The cleaning flow is one lazy plan; its only shuffle is the final dedup, whose
partial aggregate collapses copies map-side (a row copied a billion times
costs one row per task before the exchange).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions.calendar import parse_datetime
from wardstat.functions.text import strip_title


#: bits of the bitmap by which ``dedup_wide`` tells rows without a copy
FILTER_BITS = 27


def canonical_columns(df: DataFrame, aliases: dict[str, str] = K.HEADER_ALIASES) -> DataFrame:
    """Rename raw headers (``Date``, ``DISTRICT``, ``Crime Type``, ``LAT`` ...) to
    ``date, district, crime_type, latitude, longitude``.

    Two headers mapping to one name (``Date`` and ``DATE``) are rejected: Spark
    resolves names case-insensitively, so either choice would be silent data loss.
    """
    targets: dict[str, list[str]] = {}
    for c in df.columns:
        t = aliases.get(c, c)
        targets.setdefault(t, []).append(c)
    clashes = {t: src for t, src in targets.items() if len(src) > 1}
    folded: dict[str, list[str]] = {}
    for t in targets:
        folded.setdefault(t.lower(), []).append(t)
    clashes.update({k: v for k, v in folded.items() if len(v) > 1})
    if clashes:
        raise ValueError(f"ambiguous headers map to the same column: {clashes}")
    renames = {c: aliases[c] for c in df.columns if c in aliases and aliases[c] != c}
    return df.withColumnsRenamed(renames) if renames else df


def if_has(df: DataFrame, cols: str | Iterable[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``fn`` only when every column in ``cols`` exists (decided at plan time)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    return fn(df) if all(c in df.columns for c in cols) else df


def parse_dates(df: DataFrame, text_col: str = "date", out_col: str = "ts") -> DataFrame:
    """R3 on a column: tolerant parse into ``out_col`` (``TIMESTAMP_NTZ``); drops the text."""
    out = df.withColumn(out_col, parse_datetime(text_col))
    return out.drop(text_col) if text_col != out_col else out


def tidy_labels(df: DataFrame, cols=("district", "crime_type")) -> DataFrame:
    """R1 on the label columns present."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: strip_title(c) for c in present}) if present else df


def drop_undated(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Drop rows whose date is missing or did not parse."""
    return df.where(F.col(ts_col).isNotNull())


def fill_district(df: DataFrame, label: str = K.NULL_DISTRICT, col: str = "district") -> DataFrame:
    """P4 (T3: the original intends ``Unknown``; pass ``label='Nan'`` for its literal output)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(label)))


def fill_type(df: DataFrame, label: str = K.NULL_TYPE, col: str = "crime_type") -> DataFrame:
    """P5: ``Other`` in the cleaner, ``General Crime`` on upload (T4)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(label)))


def missing_coordinates(df: DataFrame) -> DataFrame:
    """Rows missing either coordinate."""
    return df.where(F.col("latitude").isNull() | F.col("longitude").isNull())


def for_district(df: DataFrame, district: str, col: str = "district") -> DataFrame:
    """One district, or every row for ``'all'``. Pushed to the scan as a filter."""
    return df if district == "all" else df.where(F.col(col) == F.lit(district))


def type_matches(df: DataFrame, pattern: str, col: str = "crime_type") -> DataFrame:
    """P10: rows whose type matches a (Java) regular expression."""
    return df.where(F.col(col).rlike(pattern))


def column_report(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Rows ``ordinal, column_name, data_type, nullable, non_null`` for ``cols``
    (default: every column). The names and types come from the schema; the
    non-null counts from one aggregate pass over the table (partial counts per
    task, one row after the exchange), unpacked into one row per column."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if cols is None or f.name in set(cols)]
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"_n{i}") for i, f in fields])
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(f.nullable).alias("nullable"), F.col(f"_n{i}").alias("non_null"),
        )
        for i, f in fields
    ])
    return counts.select(F.inline(rows))


def date_like_columns(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Columns whose name mentions date, month or year, with their non-null counts."""
    names = [c for c in df.columns if any(k in c.lower() for k in ("date", "month", "year"))]
    return column_report(df, names).select("ordinal", "column_name", "non_null")


def describe_schema(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Name, type, nullability and position of every column, with its non-null count."""
    return column_report(df)


def dedup(df: DataFrame) -> DataFrame:
    """Drop fully duplicated rows; nulls compare equal."""
    return df.dropDuplicates()


def dedup_wide(df: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """E1 for wide rows that are mostly unique: only rows that may have a copy are exchanged.

    128-bit fingerprints (two longs a row) are counted first; those that repeat set bits of a bitmap of
    fixed size (2^27 bits are 16 MB, whatever the table holds), which is broadcast. A
    row whose bit isn't set has no copy and stays where it is. The others, rows with copies and the few whose
    bit another fingerprint set, are compared as whole rows. The result is exact: equal rows have equal
    fingerprints, and unequal ones are never merged. With more repeated fingerprints than the
    bitmap can tell apart, more rows are exchanged, at most all of them, as by ``dedup``."""
    if not df.columns:
        return df.dropDuplicates()
    cols = [F.col(f"`{c}`") for c in df.columns]
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    marks = df.select(one.alias("a"), two.alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = lambda h: F.pmod(h, F.lit(1 << bits)) + 1
    spots = marks.select(place(F.col("a")).alias("p"))
    bitmap = spots.groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    told = df.withColumn("_spot", place(one)).withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    told = told.join(F.broadcast(bitmap), "_bucket", "left")  # 2^bits / 32768 rows of 4 kB at most
    at = F.bitmap_bit_position("_spot")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    copied = F.col("_bits").isNotNull() & (F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2 == 1)
    told = told.withColumn("_copied", copied).select(*cols, "_copied")
    return told.where(~F.col("_copied")).select(*cols).unionByName(told.where("_copied").select(*cols).dropDuplicates())


def new_values(new: DataFrame, old: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``col`` in ``new`` that ``old`` lacks (``EXCEPT``).

    Both sides are reduced to their distinct values first (partial aggregation
    before the exchange), so the anti join shuffles distinct values, not rows."""
    n = new.select(col).where(F.col(col).isNotNull()).distinct()
    o = old.select(col).where(F.col(col).isNotNull()).distinct()
    return n.join(o, col, "left_anti")


def clean_incidents(
    df: DataFrame,
    date_col: str = "date",
    null_district: str = K.NULL_DISTRICT,
    null_type: str = K.NULL_TYPE,
    ts_col: str = "ts",
) -> DataFrame:
    """The cleaning flow: headers -> parse dates -> title-case labels -> drop
    undated -> fill labels -> dedup. Steps whose columns are absent are skipped."""
    out = canonical_columns(df)
    out = if_has(out, date_col, lambda d: parse_dates(d, date_col, ts_col))
    out = tidy_labels(out)
    out = if_has(out, ts_col, lambda d: drop_undated(d, ts_col))
    out = if_has(out, "district", lambda d: fill_district(d, null_district))
    out = if_has(out, "crime_type", lambda d: fill_type(d, null_type))
    return dedup(out)
