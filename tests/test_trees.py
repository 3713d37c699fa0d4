"""Trees as node tables: equal to MLlib on every row, and DuckDB predicts from the same rows."""

import duckdb
import pytest

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F
from wardstat.operators import forecast as FC
from wardstat.operators import risk as RK
from wardstat.operators import trees as TR

WALK = """
with recursive walk as (
  select x.id, n.tree, n.node, n.feature, n.threshold, n.left_child, n.right_child, n.prediction, n.weight, n.stats, n.n, x.v from x join nodes n on n.node = 0
  union all
  select w.id, n.tree, n.node, n.feature, n.threshold, n.left_child, n.right_child, n.prediction, n.weight, n.stats, n.n, w.v
  from walk w join nodes n on n.tree = w.tree and n.node = case when w.v[w.feature + 1] <= w.threshold then w.left_child else w.right_child end
  where w.left_child >= 0)
"""


@pytest.fixture(scope="module")
def boosted(spark):
    x = spark.range(300).select(
        "id", *[(F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) / 1000.0).alias(f"f{k}") for k in range(3)]
    ).withColumn("y", F.sin(F.col("f0") * 6) + F.col("f1") * F.col("f2"))
    x = x.coalesce(1)
    data = VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="features").transform(x)
    model = GBTRegressor(labelCol="y", maxIter=8, maxDepth=4, seed=3).fit(data)
    return model, data


def test_boosted_trees_are_mllibs_and_duckdbs(spark, boosted, tmp_path):
    model, data = boosted
    nodes = TR.node_table(spark, model)
    walked = TR.Ensemble(nodes).predict(F.array("f0", "f1", "f2"))
    rows = model.transform(data).select("id", "f0", "f1", "f2", "prediction", walked.alias("walked")).collect()
    assert len({r["walked"] for r in rows}) > 20
    assert all(r["walked"] == pytest.approx(r["prediction"], rel=1e-12) for r in rows)
    nodes.coalesce(1).write.parquet(str(tmp_path / "nodes"))
    con = duckdb.connect()
    con.execute(f"create view nodes as select * from '{tmp_path}/nodes/*.parquet'")
    con.execute("create table x(id bigint, v double[])")
    con.executemany("insert into x values (?, ?)", [(r["id"], [r["f0"], r["f1"], r["f2"]]) for r in rows])
    sql = dict(con.execute(WALK + "select id, sum(weight * prediction) from walk where left_child < 0 group by id").fetchall())
    assert all(sql[r["id"]] == pytest.approx(r["prediction"], rel=1e-9) for r in rows)


def test_rolling_is_feeding_back_by_hand(spark, boosted):
    model, _ = boosted
    ensemble = TR.Ensemble(TR.node_table(spark, model))
    frame = spark.createDataFrame([(0, [0.1, 0.9, 0.4], 6), (1, [0.7, 0.2, 0.5], 3), (2, [0.5, 0.5, 0.5], 0)], "id int, w array<double>, h int")
    got = {r["id"]: r["p"] for r in frame.select("id", ensemble.rolled(F.col("w"), F.col("h")).alias("p")).collect()}
    for i, w, h in frame.collect():
        want = []
        for _ in range(h):
            p = spark.createDataFrame([(w,)], "w array<double>").select(ensemble.predict(F.col("w"))).first()[0]
            want.append(p)
            w = [p, *w[:-1]]
        assert got[i] == pytest.approx(want)


def _features(spark):
    rows = [(f"d{i}", float(50 + 7 * i), float(i % 9), float(i * i % 31), float(i * 5 % 23), float(i % 4), float(i * 3 % 40), float(i * 7 % 30), float(i % 50)) for i in range(60)]
    return spark.createDataFrame(rows, ["district", *RK.FEATURES])


def test_forest_is_mllibs_and_duckdbs(spark, tmp_path):
    features = _features(spark)
    model = RK.train_risk(features, num_trees=12)
    forest = model.stages[-1]
    nodes = TR.node_table(spark, forest)
    labels = model.stages[0].labels
    walked = RK.predict_risk_nodes(nodes, labels, features)
    mllib = {r["district"]: r for r in RK.predict_risk(model, features).collect()}
    rows = walked.collect()
    assert len(rows) == 60 and len({r["risk_level"] for r in rows}) > 1
    for r in rows:
        want = mllib[r["district"]]
        assert r["risk_level"] == want["risk_level"] and r["confidence"] == pytest.approx(want["confidence"], rel=1e-12)
        assert r["probabilities"] == pytest.approx(want["probabilities"], rel=1e-12)
    shares = {r["feature"]: r["importance"] for r in TR.importances(nodes, RK.FEATURES).collect()}
    assert shares == pytest.approx(dict(RK.forest_importance(model)), abs=1e-12) and sum(shares.values()) == pytest.approx(1)
    # DuckDB, from the node table alone
    nodes.coalesce(1).write.parquet(str(tmp_path / "nodes"))
    con = duckdb.connect()
    con.execute(f"create view nodes as select * from '{tmp_path}/nodes/*.parquet'")
    con.execute("create table x(id varchar, v double[])")
    con.executemany("insert into x values (?, ?)", [(r["district"], [r[f] for f in RK.FEATURES]) for r in features.collect()])
    sql = con.execute(WALK + f"select id, {', '.join(f'avg(stats[{k + 1}] / n)' for k in range(len(labels)))} from walk where left_child < 0 group by id").fetchall()
    assert all(list(p) == pytest.approx([mllib[i]["probabilities"][label] for label in labels]) for i, *p in sql)
    by_sql = con.execute(
        "with g as (select tree, feature, sum(gain * n) as g from nodes where left_child >= 0 group by 1, 2), "
        "s as (select feature, g / sum(g) over (partition by tree) as s from g) select feature, sum(s) / (select count(distinct tree) from g) from s group by 1"
    ).fetchall()
    assert {RK.FEATURES[f]: v for f, v in by_sql} == pytest.approx({k: v for k, v in shares.items() if v})


def test_one_plan_for_the_horizon(spark):
    """No model transform and no Python in the forecast's plan, and as many stages for 40 months as for 2."""
    from tests_series import wavy_series

    counts = set()
    for h in (2, 40):
        fc = FC.forecast_lag_gbt(FC.horizon_frame(wavy_series(spark), h), max_iter=2)
        plan = fc._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "UDF" not in plan
        counts.add(plan.count("Exchange"))
        assert fc.count() == 2 * h
    assert len(counts) == 1


def test_single_leaf(spark):
    x = spark.range(20).select(F.lit(1.0).alias("f0"), F.lit(2.0).alias("y"))
    data = VectorAssembler(inputCols=["f0"], outputCol="features").transform(x)
    nodes = TR.node_table(spark, GBTRegressor(labelCol="y", maxIter=2).fit(data))
    assert spark.range(1).select(TR.Ensemble(nodes).predict(F.array(F.lit(5.0)))).first()[0] == pytest.approx(2.0)
    assert TR.importances(nodes, ["f0"]).collect()[0]["importance"] == 0.0


def test_every_district_is_told_by_a_forest_that_has_not_seen_it(spark):
    features = _features(spark)
    data = RK.with_folds(features, 3)
    fitted = RK.fold_forests(data, num_trees=6)
    scored = {r["district"]: r for r in RK.out_of_fold(spark, data, fitted).collect()}
    assert len(scored) == 60 and sorted(fitted) == sorted({r["fold"] for r in scored.values()}) == [0, 1, 2]
    folds = {}
    for fold, model in fitted.items():
        for r in RK.predict_risk(model, data.where(F.col("fold") == fold)).collect():
            folds[r["district"]] = fold
            assert (scored[r["district"]]["prediction"], scored[r["district"]]["confidence"]) == (r["risk_level"], pytest.approx(r["confidence"]))
    assert folds == {d: r["fold"] for d, r in scored.items()}
    truth = {r["district"]: r["risk_level"] for r in RK.labelled(features).collect()}
    assert {d: r["label"] for d, r in scored.items()} == truth
    metrics = {r["fold"]: r for r in RK.fold_metrics(RK.out_of_fold(spark, data, fitted)).collect()}
    for fold, m in metrics.items():
        rows = [r for r in scored.values() if r["fold"] == fold]
        right = [r for r in rows if r["prediction"] == r["label"]]
        assert m["districts"] == len(rows) and m["accuracy"] == pytest.approx(len(right) / len(rows))
        assert m["confidence_right"] == pytest.approx(sum(r["confidence"] for r in right) / len(right))


def test_folds_do_not_depend_on_partitions(spark):
    data = _features(spark)
    told = [{r[0]: r[1] for r in data.repartition(n).select("district", RK.fold_of(5)).collect()} for n in (1, 7)]
    assert told[0] == told[1] and set(told[0].values()) == set(range(5))


def test_folds_without_a_choice(spark):
    """One fold in all: nothing to learn from; one level in all others: that level; no rows: no rows."""
    features = _features(spark)
    alone = RK.with_folds(features, 1)
    assert RK.fold_forests(alone) == {0: None}
    scored = RK.out_of_fold(spark, alone, {0: None})
    assert scored.where("prediction is null and confidence is null").count() == 60
    assert RK.fold_metrics(scored).first()["accuracy"] is None
    level = RK.with_folds(features).groupBy("label").count().orderBy("count").first()["label"]
    same = RK.with_folds(features, 2).where(F.col("label") == level)
    fitted = RK.fold_forests(same)
    assert set(fitted.values()) <= {level, None}
    none = same.where("false")
    assert RK.fold_forests(none) == {} and RK.fold_metrics(RK.out_of_fold(spark, none, {})).count() == 0
