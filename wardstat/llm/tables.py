"""Reading the input tables and writing shared intermediates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.session import write_table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; Spark's reader alone touches the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Only the named columns, cast, so that no other column can clash."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns])


def documents(df: DataFrame) -> DataFrame:
    return pick(df, [("doc_id", "long"), ("text", "string")])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate to the shared folder and continue from the files."""
    return write_table(df, f"llm-{name}")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo n (null id: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns, whatever their names), ``doc_id`` and ``row`` (a hash of the text)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"))


def join_rows(docs: DataFrame, marks: DataFrame, how: str, max_rows: int = 1_000_000) -> DataFrame:
    """``keyed`` rows with the marks of their ``doc_id`` (null equals null) and ``row``; few marks are broadcast."""
    marks = F.broadcast(marks) if small_enough(marks, max_rows) else marks
    on = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.row") == F.col("m.row"))
    return docs.alias("d").join(marks.alias("m"), on, how)
