"""Map-ready tables (A27-A29): district markers, density grid, region totals.

All three are single hash aggregates over the incident table (partial
aggregation before the exchange), so a hot district or cell costs one partial
row per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions.numeric import risk_colour


def hotspot_level(crimes, high: int = K.HOTSPOT_HIGH, medium: int = K.HOTSPOT_MEDIUM):
    c = F.col(crimes) if isinstance(crimes, str) else crimes
    return F.when(c >= high, "High").when(c >= medium, "Medium").otherwise("Low")


def hotspots(df: DataFrame, high: int = K.HOTSPOT_HIGH, medium: int = K.HOTSPOT_MEDIUM) -> DataFrame:
    """Per district centroid, count, level, colour and circle radius (count x 20)."""
    g = (
        df.where(F.col("district").isNotNull())
        .groupBy(F.col("district").alias("name"))
        .agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lng"), F.count(F.lit(1)).alias("crimes"))
    )
    lvl = hotspot_level("crimes", high, medium)
    return g.withColumns(
        {
            "risk": lvl,
            "colour": risk_colour(lvl),
            "radius": F.col("crimes") * K.HOTSPOT_RADIUS_PER_CASE,
        }
    )


def heat_grid(df: DataFrame, cell: float = 0.01) -> DataFrame:
    """Incidents per ``cell`` x ``cell`` degree square, with the cell centre."""
    gy = F.floor(F.col("latitude") / cell).cast("long")
    gx = F.floor(F.col("longitude") / cell).cast("long")
    g = (
        df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .groupBy(gy.alias("cell_y"), gx.alias("cell_x"))
        .agg(F.count(F.lit(1)).alias("crimes"))
    )
    return g.withColumns(
        {"lat": (F.col("cell_y") + 0.5) * cell, "lng": (F.col("cell_x") + 0.5) * cell}
    )


#: side of the quadtree's root square in degrees, its corner, and the deepest level (about 600 m)
ROOT, SOUTH, WEST, DEEPEST = 360.0, -90.0, -180.0, 16


def adaptive_cells(df: DataFrame, most: int = 100, deepest: int = DEEPEST) -> DataFrame:
    """A28 with cells as small as the incidents there ask for: a quadtree whose cells of more than ``most``
    incidents are split, down to ``deepest``. Leaves that hold any: ``level, cell_y, cell_x, crimes, lat, lng, side``.

    Rows are counted once, in the deepest cells (partial counts first, so a hot cell is a row for each
    task); those counts are added up for all levels, and a cell is a leaf if its parent splits and it doesn't."""
    fine = ROOT / 2**deepest
    y, x = F.floor((F.col("latitude") - SOUTH) / fine).cast("long"), F.floor((F.col("longitude") - WEST) / fine).cast("long")
    placed = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    counts = placed.groupBy(y.alias("y"), x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level")
    every = counts.select("y", "x", "n", level).select(
        "level", *[F.floor(F.col(c) / F.pow(F.lit(2.0), deepest - F.col("level"))).cast("long").alias(f"cell_{c}") for c in "yx"], "n"
    )
    cells = every.groupBy("level", "cell_y", "cell_x").agg(F.sum("n").alias("crimes"))
    split = cells.where((F.col("crimes") > most) & (F.col("level") < deepest))
    parents = split.select((F.col("level") + 1).alias("level"), F.col("cell_y").alias("py"), F.col("cell_x").alias("px"))
    up = cells.where((F.col("crimes") <= most) | (F.col("level") == deepest))
    up = up.withColumns({"py": F.floor(F.col("cell_y") / 2).cast("long"), "px": F.floor(F.col("cell_x") / 2).cast("long")})
    leaves = up.join(parents, ["level", "py", "px"], "left_semi").unionByName(up.where("level = 0")).drop("py", "px")
    side = F.lit(ROOT) / F.pow(F.lit(2.0), F.col("level"))
    return leaves.withColumns({"lat": (F.col("cell_y") + 0.5) * side + SOUTH, "lng": (F.col("cell_x") + 0.5) * side + WEST, "side": side})


def smoothed_grid(df: DataFrame, cell: float = 0.01, sigma: float = 1.5, reach: int = 3) -> DataFrame:
    """A28 as a density: every occupied cell's ``crimes``, and ``density``, the incidents around it weighed by a
    Gaussian of ``sigma`` cells within ``reach`` cells. A cell gives a share to each cell around (a fixed number
    of rows), and shares are added up; no cell is joined with all others."""
    grid = heat_grid(df, cell)
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    weigh = lambda dy, dx: F.exp(F.lit(-(dy * dy + dx * dx) / (2 * sigma * sigma)))
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), weigh(dy, dx).alias("w")) for dy, dx in steps])).alias("o")
    given = grid.select("cell_y", "cell_x", "crimes", around).select(
        (F.col("cell_y") + F.col("o.dy")).alias("cell_y"), (F.col("cell_x") + F.col("o.dx")).alias("cell_x"), (F.col("crimes") * F.col("o.w")).alias("share")
    )
    density = given.groupBy("cell_y", "cell_x").agg(F.sum("share").alias("density"))
    return grid.join(density, ["cell_y", "cell_x"])


def region_totals(df: DataFrame) -> DataFrame:
    """Incidents per (state, district) with state subtotals and a grand total
    (``ROLLUP``); ``level`` says which."""
    g = df.rollup("state", "district").agg(F.count(F.lit(1)).alias("crimes"), F.grouping_id().alias("_gid"))
    level = F.when(F.col("_gid") == 0, "district").when(F.col("_gid") == 1, "state").otherwise("all")
    return g.withColumn("level", level).drop("_gid")
