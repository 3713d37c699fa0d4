"""Nested payload expressions (R24-R27). Aggregate expressions run inside a
``groupBy(...).agg`` so every list/map is built per group on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions._util import col_of


def map_of(key, value) -> Column:
    """R24 (aggregate): ``MAP<key, value>`` of the group, keys sorted."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(col_of(key).alias("k"), col_of(value).alias("v")))))


def ordered_points(order_col: str, *cols: str) -> Column:
    """R25 (aggregate): list of structs ordered by ``order_col`` (first struct field)."""
    return F.sort_array(F.collect_list(F.struct(F.col(order_col), *[F.col(c) for c in cols])))


def as_json(*cols) -> Column:
    """Payload struct to JSON text."""
    return F.to_json(F.struct(*[col_of(c) for c in cols]))


def selection_note(model, mae) -> Column:
    """``ARIMA selected with MAE of 12.34``."""
    return F.format_string(K.SELECTION_NOTE, F.upper(col_of(model)), col_of(mae))
