"""Registry of the queries the driver runs, with their DuckDB oracles.

Each query takes ``(spark, sf_dir)``, reads the driver tables through the
fixture views, runs library operators and returns a DataFrame. Doubles are
rounded to 6 places on both sides so the engines' last-bit differences do not
change the value hash. Queries without an oracle get the rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, ShortType

from wardstat.sources.views import Fixtures, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_views(oracle)
        return fn

    return deco


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


def r6(df: DataFrame) -> DataFrame:
    """Round every top-level double column to 6 places and widen small integers
    to BIGINT (DuckDB's type for counts, row numbers and date parts)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), 6).alias(f.name))
        elif isinstance(f.dataType, (IntegerType, ShortType, ByteType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(cols)


def load_all() -> None:
    """Import every module that registers queries."""
    from wardstat.plans import queries_core, queries_io, queries_model, queries_orders, queries_scale  # noqa: F401
