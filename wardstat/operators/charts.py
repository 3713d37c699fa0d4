"""Chart datasets as tidy rows (M16). Drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.operators.risk import feature_long


def model_performance_rows(scores: DataFrame) -> DataFrame:
    """MAE per model and district, label with one decimal, best model flagged.

    The best model is found by a window over each district's score rows (at most one
    per model): the scores come out of a ``district`` aggregate, so no new exchange."""
    from pyspark.sql import Window

    from wardstat.operators.forecast import best_model_expr

    best = best_model_expr().over(Window.partitionBy("district"))
    return scores.withColumn("best_model", best).select(
        "district",
        "model",
        "mae",
        F.format_string("%.1f", F.col("mae")).alias("mae_label"),
        (F.col("model") == F.col("best_model")).alias("is_best"),
    )


def trend_rows_from_table(table: DataFrame, models=("arima", "sarima")) -> DataFrame:
    """One row per (district, month, model) with the value and a best flag, from the
    wide M6 table (values already clamped, best model already on each row): an
    unpivot, no join."""
    long_ = table.unpivot(["district", "month", "best_model"], list(models), "model", "value")
    return long_.select(
        "district",
        "month",
        F.upper("model").alias("series"),
        F.col("value").cast("double").alias("value"),
        (F.col("model") == F.col("best_model")).alias("is_best"),
    )


def parameter_rows(features: DataFrame) -> DataFrame:
    """The 8 risk parameters with their display labels."""
    return feature_long(features, labels=True)
