"""Sorts, top-k, previews and sampling.

Top-k is ``orderBy(...).limit(k)``, which Spark plans as
``TakeOrderedAndProject``: each task keeps a k-row heap, only k rows per task
reach the final merge. Per-group heads use a window only on bounded inputs
(forecast rows: districts x horizon)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.operators.aggregates import value_counts
from wardstat.operators.series import numbered


def by_time(df: DataFrame, ts_col: str = "ts", tie: str = "case_no") -> DataFrame:
    """L1: sort by event time (ties by case number). Range-partitioned global sort."""
    return df.orderBy(F.col(ts_col), F.col(tie))


def order_check(before: DataFrame, after: DataFrame, key: str = "case_no") -> DataFrame:
    """L7 as a measure (one row): rows and distinct keys after, and how many
    rows no longer follow the row they followed before.

    Both sides are numbered where they stand; ``after`` is numbered in its own row order."""
    a = before.select(key).withColumn("_a", F.monotonically_increasing_id())
    b = after.select(key).withColumn("_b", F.monotonically_increasing_id())
    both = a.join(b, key)
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"),
        F.count_if(F.col("_a") != F.col("_b")).alias("moved"),
    )


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """L2/L3: the k most frequent values of ``col`` (ties by value)."""
    return value_counts(df, col).limit(k)


def top_districts(df: DataFrame, k: int = 5) -> DataFrame:
    return top_k(df, "district", k)


def top_types(df: DataFrame, k: int = 5) -> DataFrame:
    return top_k(df, "crime_type", k)


def preview(df: DataFrame, n: int = 5, key: str = "case_no") -> DataFrame:
    """L4: first n rows in key order (deterministic ``head``)."""
    return df.orderBy(key).limit(n)


def sample_values(df: DataFrame, cols: Iterable[str], n: int = 10, key: str = "case_no") -> DataFrame:
    """First n values of each column (as text) in key order.

    The first n rows are the same for every column, so this is one top-n
    (``TakeOrderedAndProject``, one scan) followed by an unpivot of n rows."""
    cols = list(cols)
    head = df.orderBy(key).limit(n).select(F.col(key), *[F.col(c).cast("string").alias(c) for c in cols])
    return head.unpivot([key], cols, "column_name", "value")


def head_per_district(fc: DataFrame, n: int = 3, order: str = "k") -> DataFrame:
    """First n forecast points of every district (input is districts x horizon)."""
    w = Window.partitionBy("district").orderBy(order)
    return fc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


#: odd multipliers and additions of the rounds of ``permuted`` (fixed values)
_ROUNDS = ((40503, 30011), (48271, 12289), (69621, 24593), (16807, 49157))


def permuted(number: Column, seed: int = 42, half: int = 20) -> Column:
    """A keyed bijection of the numbers below 2^(2 half): four Feistel rounds on two halves of
    ``half`` bits (30 at most, so that no product leaves a long)."""
    size = 1 << half
    left, right = F.floor(number / size).cast("long"), F.pmod(number, F.lit(size)).cast("long")
    for k, (times, plus) in enumerate(_ROUNDS):
        mixed = F.pmod(right * times + plus + seed * (k + 1), F.lit(size * 1021)).cast("long")
        mixed = F.pmod(F.floor(mixed / 509) + mixed * 31, F.lit(size)).cast("long")
        left, right = right, F.pmod(left + mixed, F.lit(size)).cast("long")
    return left * size + right


def shuffle_by_key(df: DataFrame, *key, seed: int = 42, half: int = 20) -> DataFrame:
    """L7 whose order is a function of the rows alone: rows are numbered by ``key`` (unique), and sorted by
    a keyed bijection of the number, so the order is the same under any partitioning and any
    number of tasks; another ``seed`` gives another one. Adds ``number``; ``half`` bits twice must hold the rows."""
    told = numbered(df, *key, name="number")
    return told.orderBy(permuted(F.col("number"), seed, half))


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """Random row order (reproducible for a fixed seed and partitioning)."""
    return df.orderBy(F.rand(seed))
