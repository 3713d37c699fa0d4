"""Fitted tree ensembles as tables, and their predictions as Catalyst expressions.

``node_table`` reads a saved model's nodes as rows. ``Ensemble`` packs them into flat arrays
(children by position), which a projection holds as constants: a tree is walked by
``aggregate()``, an ensemble is a sum over its roots, and a forecast that feeds predictions back is
an ``aggregate()`` over the horizon. So a prediction is a part of any plan, without a model transform
(or a driver step) for each month, and SQL can predict from the same rows.

What is collected is the model, which the driver holds anyway: trees times nodes, whatever the rows
it was fitted to. Splits are on continuous features, as assembled vectors without metadata have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.session import scratch_folder


def node_table(spark: SparkSession, model, path: str | None = None) -> DataFrame:
    """``tree, node, feature, threshold, left_child, right_child, prediction, stats, n, gain, weight`` of a
    fitted tree ensemble. It is saved to ``path`` (the caller's), or to a scratch folder of the session.
    Leaves have feature and children -1; ``stats`` are the classes' weights (classification), ``n`` their sum."""
    path = path or scratch_folder(spark, "trees")
    model.write().overwrite().save(path)
    nodes, trees = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/treesMetadata")
    if nodes.where("nodeData.split.numCategories >= 0").limit(1).count():
        raise ValueError("splits on categories aren't supported")
    split = F.col("nodeData.split")
    rows = nodes.select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), split["featureIndex"].alias("feature"),
        F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), F.col("nodeData.leftChild").alias("left_child"),
        F.col("nodeData.rightChild").alias("right_child"), F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.impurityStats").alias("stats"), F.aggregate("nodeData.impurityStats", F.lit(0.0), lambda s, v: s + v).alias("n"), F.col("nodeData.gain").alias("gain"),
    )
    return rows.join(trees.select(F.col("_1").alias("tree"), F.col("_3").alias("weight")), "tree")


def _constant(values: Sequence, kind: str) -> Column:
    """An array that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


class Ensemble:
    """Nodes of all trees in flat arrays."""

    def __init__(self, nodes: DataFrame):
        rows = nodes.orderBy("tree", "node").collect()
        roots = [i for i, r in enumerate(rows) if r["node"] == 0]
        start = {rows[i]["tree"]: i for i in roots}
        below = {}
        for i in range(len(rows) - 1, -1, -1):  # children follow their parent
            r = rows[i]
            kids = [start[r["tree"]] + r[c] for c in ("left_child", "right_child") if r[c] >= 0]
            below[i] = 1 + max(below[k] for k in kids) if kids else 0
        self.trees = len(roots)
        self.depth = max((below[i] for i in roots), default=0)
        self.roots, self.weights = _constant(roots, "int"), _constant([rows[i]["weight"] for i in roots], "double")
        self.feature = _constant([r["feature"] for r in rows], "int")
        self.threshold = _constant([r["threshold"] if r["threshold"] is not None else 0.0 for r in rows], "double")
        self.left = _constant([start[r["tree"]] + r["left_child"] if r["left_child"] >= 0 else -1 for r in rows], "int")
        self.right = _constant([start[r["tree"]] + r["right_child"] if r["right_child"] >= 0 else -1 for r in rows], "int")
        self.values = _constant([r["prediction"] for r in rows], "double")
        classes = len(rows[0]["stats"]) if rows else 0
        self.shares = [_constant([r["stats"][k] / r["n"] if r["n"] else 0.0 for r in rows], "double") for k in range(classes)]

    def leaf(self, x: Column, root: Column) -> Column:
        """Position of the leaf that the features (an array) reach."""

        def step(at, _):
            side = F.when(F.get(x, F.get(self.feature, at)) <= F.get(self.threshold, at), F.get(self.left, at)).otherwise(F.get(self.right, at))
            return F.when(F.get(self.left, at) < 0, at).otherwise(side)

        return F.aggregate(F.sequence(F.lit(1), F.lit(max(self.depth, 1))), root, step)

    def _total(self, x: Column, values: Column) -> Column:
        terms = F.zip_with(self.roots, self.weights, lambda root, w: w * F.get(values, self.leaf(x, root)))
        return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)

    def predict(self, x: Column) -> Column:
        """Weighted sum of the trees' predictions (boosted regression)."""
        return self._total(x, self.values)

    def probabilities(self, x: Column) -> Column:
        """Array of the classes' probabilities (forest): the mean of the leaves' shares."""
        votes = F.array(*[self._total(x, share) for share in self.shares])
        total = F.aggregate(votes, F.lit(0.0), lambda s, v: s + v)
        return F.transform(votes, lambda v: v / total)

    def rolled(self, window: Column, steps: Column) -> Column:
        """Predictions 1 .. ``steps``, each put in front of the window (newest first) that predicts the next."""
        start = F.struct(window.alias("window"), F.array().cast("array<double>").alias("path"))

        def step(s, _):
            def fed(p):
                moved = F.concat(F.array(p), F.slice(s["window"], F.lit(1), F.size(s["window"]) - 1))
                return F.struct(moved.alias("window"), F.concat(s["path"], F.array(p)).alias("path"))

            return F.get(F.transform(F.array(self.predict(s["window"])), fed), F.lit(0))

        path = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step, lambda s: s["path"])
        return F.slice(path, F.lit(1), F.greatest(steps, F.lit(0)))


def importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """M13 from the node table: ``feature, importance``; gains weighted by the rows that reach
    the split, shares of each tree, then of the forest. A feature without a split has 0."""
    gains = nodes.where("left_child >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("gain"))
    whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole")).where("whole > 0")
    shares = gains.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.lit(name).alias("name")) for i, name in enumerate(features)]))
    every = nodes.limit(1).select(names.alias("f")).select("f.feature", "f.name").join(shares, "feature", "left")
    total = nodes.where("left_child >= 0").select("tree").distinct().join(whole, "tree").agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    return every.select(F.col("name").alias("feature"), (F.coalesce("share", F.lit(0.0)) / total.scalar()).alias("importance"))
