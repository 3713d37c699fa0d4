"""District risk: features, rule score, random forest.

Features are one ``groupBy('district')`` with conditional counts, so the
incident table is scanned once and pre-aggregated map-side; everything after
that runs on one row per district. MLlib trains on that feature table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat import constants as K
from wardstat.functions.calendar import is_weekend
from wardstat.functions.numeric import clamp
from wardstat.operators.trees import Ensemble, node_table
from wardstat.session import materialize

FEATURES = [name for name, _ in K.RISK_FEATURES]
EVENING_AFTER = 18  # R11: evening is hour > 18
NIGHT_UNTIL = 6  # R11: night is hour <= 6


def risk_features(df: DataFrame, dim: DataFrame | None = None, class_map: dict | None = None, ts_col: str = "ts") -> DataFrame:
    """Per district total, violent, property and drug counts; evening, night and
    weekend shares in percent; crime rate per 1000 residents when ``dim`` has
    ``population`` (NULL otherwise, so P13 can default it)."""
    class_map = class_map or {}
    hour = F.hour(ts_col)
    n = F.count(F.lit(1))

    def cls(name):
        types = class_map.get(name, ())
        return F.count_if(F.col("crime_type").isin(*types)) if types else F.lit(0).cast("long")

    feats = (
        df.where(F.col("district").isNotNull())
        .groupBy("district")
        .agg(
            n.alias("total_crimes"),
            cls("violent").alias("violent_crimes"),
            cls("property").alias("property_crimes"),
            cls("drug").alias("drug_crimes"),
            (F.count_if(hour > EVENING_AFTER) * 100.0 / n).alias("evening_crimes_pct"),
            (F.count_if(hour <= NIGHT_UNTIL) * 100.0 / n).alias("night_crimes_pct"),
            (F.count_if(is_weekend(ts_col)) * 100.0 / n).alias("weekend_crimes_pct"),
        )
    )
    if dim is not None and "population" in dim.columns:
        # Both sides hold one row per district and ``feats`` is already hash-partitioned
        # on it: a plain equi-join, no broadcast hint and no size-check job.
        feats = feats.join(dim.select("district", "population"), "district", "left")
        rate = F.when(F.col("population") > 0, F.col("total_crimes") * 1000.0 / F.col("population"))
        feats = feats.withColumn("crime_rate", rate).drop("population")
    else:
        feats = feats.withColumn("crime_rate", F.lit(None).cast("double"))
    return feats.select("district", *FEATURES)


def with_feature_defaults(df: DataFrame) -> DataFrame:
    """A missing feature takes the predictor's default (all as DOUBLE)."""
    cols = {}
    for name, default in K.RISK_FEATURES:
        src = F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")
        cols[name] = F.coalesce(src, F.lit(default))
    return df.withColumns(cols)


def feature_long(df: DataFrame, key: str = "district", labels: bool = False) -> DataFrame:
    """Wide features -> ``(key, parameter, value)`` rows (8 parameters)."""
    wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in FEATURES])
    long = wide.unpivot([key], FEATURES, "parameter", "value")
    if labels:
        m = F.create_map(*[x for pair in zip(FEATURES, K.RISK_FEATURE_LABELS) for x in (F.lit(pair[0]), F.lit(pair[1]))])
        long = long.withColumn("parameter", m[F.col("parameter")])
    return long


def class_distribution(features: DataFrame) -> DataFrame:
    """Counts by coarse class (total, violent, property, drug) as rows."""
    cols = ["total_crimes", "violent_crimes", "property_crimes", "drug_crimes"]
    return features.select("district", *cols).unpivot(["district"], cols, "crime_class", "crimes")


def time_pattern(features: DataFrame) -> DataFrame:
    """Evening, night and weekend shares as rows."""
    cols = ["evening_crimes_pct", "night_crimes_pct", "weekend_crimes_pct"]
    return features.select("district", *cols).unpivot(["district"], cols, "pattern", "pct")


def normalise(df: DataFrame, key: str, value: str, out: str | None = None) -> DataFrame:
    """``value / sum(value)`` within each ``key`` group.

    A null key is a group like any other, and a group whose total is 0 gets NULL.
    Group totals come from a partial+final aggregate and are joined back on the
    key; a hot key is then split by AQE's skew-join handling (or the totals are
    broadcast when AQE measures them small) instead of landing whole in one
    window task."""
    tot = df.groupBy(F.col(key).alias("_group")).agg(F.sum(value).alias("_group_total"))
    share = F.try_divide(F.col(value).cast("double"), F.col("_group_total").cast("double"))
    joined = df.join(tot, F.col(key).eqNullSafe(F.col("_group")), "inner")
    return joined.withColumn(out or value, share).drop("_group", "_group_total")


def risk_score(features: DataFrame) -> DataFrame:
    """M8: weighted, capped rule score. ``total_crimes <= 0`` gives NULL and a
    ``reject_reason`` (the original fails the request; ``least`` would silently
    skip the NULL ratio, T13)."""
    total = F.col("total_crimes")
    parts = []
    for feat, div, cap, weight in K.RISK_RULE:
        x = F.col("violent_crimes") / total if feat == "violent_ratio" else F.col(feat) / div
        parts.append(clamp(x, hi=cap) * weight)
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    ok = total > 0
    return features.withColumns(
        {
            "risk_score": F.when(ok, score),
            "reject_reason": F.when(~ok | total.isNull(), F.lit("total_crimes must be positive")),
        }
    )


def risk_level(score) -> "F.Column":
    """M9: > 0.7 High, > 0.4 Medium, else Low (NULL stays NULL)."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > K.RISK_HIGH, "High").when(s > K.RISK_MEDIUM, "Medium").when(s.isNotNull(), "Low")


def risk_probabilities(level) -> "F.Column":
    """Band weights of the level, normalised to sum 1, as ``MAP<level, p>``."""
    lv = F.col(level) if isinstance(level, str) else level
    entries = []
    for i, name in enumerate(K.RISK_LEVELS):
        p = None
        for lvl, w in K.RISK_BANDS.items():
            v = F.lit(w[i] / sum(w))
            p = F.when(lv == lvl, v) if p is None else p.when(lv == lvl, v)
        entries += [F.lit(name), p]
    return F.when(lv.isNotNull(), F.create_map(*entries))


def risk_confidence(level) -> "F.Column":
    """M11 (rule path): centre of the original band for the level."""
    lv = F.col(level) if isinstance(level, str) else level
    expr = None
    for lvl, c in K.RISK_CONFIDENCE.items():
        expr = F.when(lv == lvl, c) if expr is None else expr.when(lv == lvl, c)
    return expr


def rule_risk(features: DataFrame) -> DataFrame:
    """M8-M11 on features with defaults: one output schema for both paths."""
    s = risk_score(with_feature_defaults(features))
    s = s.withColumn("risk_level", risk_level("risk_score"))
    return s.withColumns(
        {
            "confidence": risk_confidence("risk_level"),
            "probabilities": risk_probabilities("risk_level"),
            "model_accuracy": F.lit(None).cast("double"),
            "feature_importance": _importance_map(dict(rule_importance())),
        }
    )


def rule_importance() -> list[tuple[str, float]]:
    """Importance of each feature on the rule path: its weight in the score (the
    violent ratio's stands for violent crimes; a feature without one has 0)."""
    weights = {("violent_crimes" if name == "violent_ratio" else name): weight for name, _, _, weight in K.RISK_RULE}
    return [(name, weights.get(name, 0.0)) for name in FEATURES]


def _importance_map(importance: dict[str, float]):
    return F.create_map(*[x for name in FEATURES for x in (F.lit(name), F.lit(float(importance.get(name, 0.0))))])


def forest_importance(model) -> list[tuple[str, float]]:
    """Importances of a fitted forest, normalised to sum 1 (8 numbers)."""
    values = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    total = sum(values) or 1.0
    return [(name, x / total) for name, x in zip(FEATURES, values)]


# --------------------------------------------------------------------------
def labelled(features: DataFrame) -> DataFrame:
    """Training label for the forest (DECISION): the rule level on the same row,
    so accuracy measures agreement with the rule."""
    return rule_risk(features).where(F.col("risk_level").isNotNull())


#: training rows are dealt into so many partitions, whatever the session's number
FIT_PARTITIONS = 8


def in_fit_order(data: DataFrame) -> DataFrame:
    """Training rows by district in a fixed number of sorted partitions: MLlib draws
    its samples by partition, so the fit then depends on the rows alone."""
    return data.repartition(FIT_PARTITIONS, "district").sortWithinPartitions("district")


def hold_out(features: DataFrame, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out districts (about one in ``folds``), by a hash of the name."""
    held = F.pmod(F.xxhash64("district"), F.lit(folds)) == 0
    return features.where(~held), features.where(held)


def held_out_metrics(features: DataFrame, num_trees: int = K.RF_TREES, seed: int = 42) -> DataFrame:
    """A25 of a forest on districts that it was not trained on (one row)."""
    fit, held = hold_out(features)
    model = train_risk(fit, num_trees, seed, materialize_input=False)
    scored = predict_risk(model, held).select("district", F.col("risk_level").alias("prediction"))
    truth = labelled(held).select("district", F.col("risk_level").alias("label"))
    return classification_metrics(truth.join(scored, "district"))


def train_risk(features: DataFrame, num_trees: int = K.RF_TREES, seed: int = 42, materialize_input: bool = True):
    """StringIndexer + VectorAssembler + RandomForestClassifier(100 trees)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    # One row per district; MLlib makes several passes (indexer, splits, bagging),
    # so the table is materialized once instead of re-aggregating incidents per pass.
    data = labelled(features).select("district", *FEATURES, "risk_level")
    data = materialize(data) if materialize_input else data
    data = in_fit_order(data)
    stages = [
        StringIndexer(inputCol="risk_level", outputCol="label", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        RandomForestClassifier(numTrees=num_trees, seed=seed, labelCol="label", featuresCol="features"),
    ]
    # A copy leaves the training summary behind. The summary refers to the session, so every task
    # closure of a prediction would carry that along, and can't once the session observes metrics.
    return Pipeline(stages=stages).fit(data).copy()


def predict_risk(model, features: DataFrame, accuracy: float | None = None) -> DataFrame:
    """M12/M11 (model path): level, confidence = top probability, map of probabilities."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    pred = model.transform(with_feature_defaults(features))
    probs = vector_to_array("probability")
    lab = F.array(*[F.lit(x) for x in labels])
    return pred.select(
        "district",
        *FEATURES,
        F.element_at(lab, F.col("prediction").cast("int") + 1).alias("risk_level"),
        F.array_max(probs).alias("confidence"),
        F.map_from_arrays(lab, probs).alias("probabilities"),
        F.lit(accuracy).cast("double").alias("model_accuracy"),
        _importance_map(dict(forest_importance(model))).alias("feature_importance"),
    )


def predict_risk_nodes(nodes: DataFrame, labels: list[str], features: DataFrame) -> DataFrame:
    """M12 from the forest's node table (``trees.node_table``): level, confidence and probabilities as one
    projection. The walk is a part of the caller's plan, and equals the model's own prediction."""
    filled = with_feature_defaults(features)
    probs = Ensemble(nodes).probabilities(F.array(*[F.col(f).cast("double") for f in FEATURES]))
    told = filled.withColumn("_p", probs)
    lab = F.array(*[F.lit(x) for x in labels])
    top = F.array_max("_p")
    return told.select(
        "district", *FEATURES, F.element_at(lab, F.array_position("_p", top).cast("int")).alias("risk_level"),
        top.alias("confidence"), F.map_from_arrays(lab, F.col("_p")).alias("probabilities"),
    )


def fold_of(folds: int, seed: int = 42) -> Column:
    """Fold of a district: a keyed hash of its name, so folds are the same under any partitioning, and SQL can tell them."""
    named = F.md5(F.concat("district", F.lit(f":{seed}")))
    return F.pmod(F.conv(F.substring(named, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def with_folds(features: DataFrame, folds: int = 3, seed: int = 42) -> DataFrame:
    """Training rows of M14: ``district``, the features, their rule level as ``label``, and ``fold``."""
    data = labelled(features).select("district", *FEATURES, F.col("risk_level").alias("label"))
    return materialize(data.withColumn("fold", fold_of(folds, seed)))


def fold_forests(data: DataFrame, num_trees: int = K.RF_TREES, seed: int = 42) -> dict:
    """For each fold with districts, the forest fitted to all other folds. It is a level's name where
    the others have that level only, and None where there are no others."""
    levels = data.groupBy("fold").agg(F.collect_set("label").alias("levels")).collect()  # a row for each fold
    fitted = {}
    for row in sorted(levels, key=lambda r: r["fold"]):
        seen = {level for r in levels if r["fold"] != row["fold"] for level in r["levels"]}
        if len(seen) > 1:
            others = data.where(F.col("fold") != row["fold"])
            fitted[row["fold"]] = train_risk(others, num_trees, seed, materialize_input=False)
        else:
            fitted[row["fold"]] = next(iter(seen), None)
    return fitted


def out_of_fold(spark, data: DataFrame, fitted: dict) -> DataFrame:
    """M14's predictions: ``district, fold, label, prediction, confidence`` of every row of ``with_folds``,
    by the forest (its node table) that hasn't seen the fold. All folds are one plan: a district's fold
    picks the forest that walks it. A fold without other rows has no prediction."""
    level, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    x = F.array(*[F.col(f).cast("double") for f in FEATURES])
    for fold, model in fitted.items():
        if model is None:
            continue
        here = F.col("fold") == fold
        if isinstance(model, str):
            level, sure = F.when(here, F.lit(model)).otherwise(level), F.when(here, F.lit(1.0)).otherwise(sure)
            continue
        probs = Ensemble(node_table(spark, model.stages[-1])).probabilities(x)
        top = F.array_max(probs)
        names = F.array(*[F.lit(label) for label in model.stages[0].labels])
        level = F.when(here, F.get(names, F.array_position(probs, top).cast("int") - 1)).otherwise(level)
        sure = F.when(here, top).otherwise(sure)
    filled = with_feature_defaults(data)
    return filled.select("district", "fold", "label", level.alias("prediction"), sure.alias("confidence"))


def fold_metrics(scored: DataFrame) -> DataFrame:
    """Per fold of ``out_of_fold``: districts, accuracy (null where nothing is predicted) and the mean confidence
    of right and of wrong predictions. The mean accuracy over the folds is M14."""
    right = F.col("prediction") == F.col("label")
    return scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("districts"), F.avg(right.cast("double")).alias("accuracy"),
        F.avg(F.when(right, F.col("confidence"))).alias("confidence_right"), F.avg(F.when(~right, F.col("confidence"))).alias("confidence_wrong"),
    )


def feature_importance(spark, model) -> DataFrame:
    """Forest importances as rows with their place, largest first.

    One entry per feature (8), so building the rows on the driver is bounded."""
    ranked = sorted(forest_importance(model), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(name, value, k) for k, (name, value) in enumerate(ranked, 1)], "feature string, importance double, position int")


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 from confusion
    counts (classes x classes rows)."""
    conf = pred.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    per = conf.groupBy("l").agg(F.sum("c").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"))
    predicted = conf.groupBy(F.col("p").alias("l")).agg(F.sum("c").alias("predicted"))
    per = per.join(predicted, "l", "full").fillna(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumns({"prec": prec, "rec": rec})
    f1 = F.when(F.col("prec") + F.col("rec") > 0, 2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0)
    n = F.sum("support")
    return per.agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / n).alias("recall"),
        (F.sum(f1 * F.col("support")) / n).alias("f1"),
    )


def cross_validate_risk(spark, features: DataFrame, folds: int = 3, num_trees: int = K.RF_TREES, seed: int = 42) -> DataFrame:
    """K-fold cross-validated accuracy of the forest (one row)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    class Forest(RandomForestClassifier):
        def _fit(self, dataset):
            return super()._fit(dataset).copy()  # without its summary, as in train_risk

    data = in_fit_order(materialize(labelled(features).select("district", *FEATURES, "risk_level")))
    rf = Forest(numTrees=num_trees, seed=seed, labelCol="label", featuresCol="features")
    pipe = Pipeline(
        stages=[
            StringIndexer(inputCol="risk_level", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
            VectorAssembler(inputCols=FEATURES, outputCol="features"),
            rf,
        ]
    )
    ev = MulticlassClassificationEvaluator(metricName="accuracy")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev, numFolds=folds, seed=seed)
    m = cv.fit(data)
    return spark.createDataFrame([(folds, float(m.avgMetrics[0]))], "folds int, cv_accuracy double")
