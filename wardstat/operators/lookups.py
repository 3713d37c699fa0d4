"""Dimension lookups.

The joins carry no hint and start no job: the planner broadcasts a dimension by
its size estimate, and AQE by the measured size of the built side, both under
``spark.sql.autoBroadcastJoinThreshold`` (bytes); a larger one is shuffled, and a
hot key of the incident side is split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_severity(df: DataFrame, lookup: DataFrame, key: str = "crime_type") -> DataFrame:
    """Type -> severity; an unmapped type gets NULL."""
    return df.join(lookup.select(key, "crime_severity"), key, "left")


def with_district_dim(df: DataFrame, dim: DataFrame, key: str = "district", cols=("state", "lat", "lon", "population")) -> DataFrame:
    """Attach state, centroid and population by district.

    Columns of ``df`` with the same name win (the dimension only fills gaps).
    """
    keep = [c for c in cols if c in dim.columns]
    d = dim.select(key, *[F.col(c).alias(f"_dim_{c}") for c in keep])
    out = df.join(d, key, "left")
    for c in keep:
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_dim_{c}"))).drop(f"_dim_{c}")
        else:
            out = out.withColumnRenamed(f"_dim_{c}", c)
    return out
