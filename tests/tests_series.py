"""Hand series that several test modules use."""

import math

from pyspark.sql import functions as F


def wavy_series(spark, n=40):
    rows = [(d, t, 50.0 + 5 * k + 10 * math.sin(t / 2 + k) + 0.3 * t) for k, d in enumerate("ab") for t in range(1, n + 1)]
    s = spark.createDataFrame(rows, "district string, t int, y double")
    return s.withColumn("month", F.add_months(F.lit("2001-01-01").cast("date"), F.col("t") - 1))
