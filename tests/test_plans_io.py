"""Physical-plan assertions and sinks/versioning."""

import os

from pyspark.sql import functions as F

from wardstat.functions.calendar import with_calendar
from wardstat.operators import aggregates as A
from wardstat.operators import forecast as FC
from wardstat.operators import series as S
from wardstat.operators.lookups import with_severity
from wardstat.operators.ordering import top_districts
from wardstat.sources import io as IO


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return _plan(df)


def test_lookup_is_broadcast(spark, fx):
    """No hint and no count job: the planner decides by size, and the final plan broadcasts."""
    from wardstat.operators.lookups import with_district_dim

    for df in (with_severity(fx.incidents_hourly, fx.severity_dim), with_district_dim(fx.incidents_hourly.select("case_no", "district"), fx.district_dim)):
        df.collect()
        p = _plan(df).split("Initial Plan")[0]
        assert "isFinalPlan=true" in p
        assert "BroadcastHashJoin" in p


def test_district_dim_does_not_sort_the_incidents(spark, fx):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(fx.district_dim)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    scan_side = p[p.rindex("Exchange hashpartitioning(district"):]
    assert "SortAggregate" not in scan_side and "HashAggregate" in scan_side


def test_topk_is_take_ordered(spark, fx):
    assert "TakeOrderedAndProject" in _plan(top_districts(fx.incidents_hourly, 5))


def test_aggregate_is_partial_then_final(spark, fx):
    df = A.type_by_district(fx.incidents_hourly)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("HashAggregate") >= 2 and "partial_count" in p


def test_scan_prunes_columns_and_pushes_filters(spark, fx):
    df = A.monthly_district(with_calendar(fx.incidents_monthly.where(F.col("ts") < F.lit("1999-01-01").cast("date"))))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate" in p  # a caller's filter reaches the parquet scan
    assert "o_totalprice" not in p and "o_orderstatus" not in p  # unused columns never read


def test_window_chain_shares_one_exchange(spark, fx):
    series = S.densify(S.monthly_counts(fx.incidents_monthly)).checkpoint(eager=True)
    frame = FC.backtest_frame(series)
    x = S.differences(S.lag_features(frame, 12))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = x._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("Exchange hashpartitioning(district") == 1



def test_backtest_plans_one_exchange(spark, fx):
    # fit, score and per-district aggregate all reuse the window chain's partitioning
    series = S.densify(S.monthly_counts(fx.incidents_monthly)).checkpoint(eager=True)
    bt = FC.backtest(series, materialize_input=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = bt._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("Exchange ") == 1 and "SortMergeJoin" not in p


def test_forecast_table_plans_one_exchange(spark, fx):
    series = S.densify(S.monthly_counts(fx.incidents_monthly)).checkpoint(eager=True)
    ft = FC.forecast_table(series, 6, materialize_input=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = ft._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("Exchange ") == 1 and "Join" not in p

def test_publish_versions_and_read_current(spark, fx, tmp_path):
    """The version committed last is current whatever its name; it has its own columns, and
    only its folder is read."""
    import pytest

    root = str(tmp_path / "published")
    with pytest.raises(FileNotFoundError):
        IO.read_current(spark, root)
    assert IO.current_version(spark, root) is None
    df = fx.incidents_hourly.select("case_no", "district")
    IO.publish(df.where(F.col("case_no") < 10), root, "v9")
    IO.publish(df.where(F.col("case_no") < 20).withColumn("added", F.lit(1)), root, "v10")
    assert IO.current_version(spark, root) == "v10"
    cur = IO.read_current(spark, root)
    assert cur.columns == ["case_no", "district", "added"]
    assert cur.count() == df.where(F.col("case_no") < 20).count()
    assert all("version=v10" in f for f in cur.inputFiles())
    assert sorted(r[0] for r in spark.read.parquet(root + "/_versions").select("version").collect()) == ["v10", "v9"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        IO.publish(df, root, "v9")
    assert IO.current_version(spark, root) == "v10"


def test_writers_and_probe(spark, fx, tmp_path):
    processed = with_calendar(fx.incidents_hourly)
    IO.write_processed(processed, str(tmp_path / "proc"))
    assert any(n.startswith("year=") for n in os.listdir(tmp_path / "proc"))
    paths = IO.write_aggregates({"daily": A.daily(processed)}, str(tmp_path / "aggs"))
    assert paths[0].endswith("daily_aggregated") and spark.read.parquet(paths[0]).count() > 0
    IO.write_summary(A.data_summary(processed), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 1
    IO.write_training_summary(spark.createDataFrame([(1, "m")], "n int, model string"), str(tmp_path / "ts"))
    assert spark.read.json(str(tmp_path / "ts")).columns == ["n"]
    pr = IO.probe(fx.incidents_raw).first()
    assert pr["n_rows"] == fx.incidents_raw.count() and pr["columns"].startswith("case_no")


def test_read_incidents_and_upload_gate(spark, fx, tmp_path):
    p = str(tmp_path / "raw_csv")
    fx.incidents_raw.write.option("header", True).csv(p)
    df = IO.read_incidents(spark, p)
    assert df.count() == fx.incidents_raw.count() and df.columns[0] == "case_no"
    assert IO.read_upload(spark, p).count() == df.count()
    import pytest

    with pytest.raises(ValueError):
        IO.read_upload(spark, str(tmp_path / "x.parquet"))
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    (mixed / "a.csv").write_text("x\n1\n")
    assert IO.read_upload(spark, str(mixed)).count() == 1
    (mixed / "b.txt").write_text("x\n1\n")
    with pytest.raises(ValueError, match="only .csv"):
        IO.read_upload(spark, str(mixed))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("x,y\n")
    with pytest.raises(ValueError, match="no rows"):
        IO.read_upload(spark, str(tmp_path / "empty"))


def test_model_save_load(spark, fx, tmp_path):
    from wardstat.operators import risk as RK
    from wardstat.sources.views import CLASS_MAP

    feats = RK.risk_features(fx.incidents_hourly, fx.district_dim, CLASS_MAP)
    m = RK.train_risk(feats, num_trees=5)
    IO.save_model(m, str(tmp_path / "rf"))
    m2 = IO.load_model(str(tmp_path / "rf"))
    a = sorted(r["risk_level"] for r in RK.predict_risk(m, feats).collect())
    b = sorted(r["risk_level"] for r in RK.predict_risk(m2, feats).collect())
    assert a == b


def test_case_id_matches_global_row_number(spark, fx):
    h = fx.incidents_hourly.select("case_no", "ts").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r["case_no"]: r["case_id"] for r in S.with_case_id(h).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    ordered = sorted(h.collect(), key=lambda r: (r["ts"], r["case_no"]))
    want = {r["case_no"]: f"CASE_{i + 1:06d}" for i, r in enumerate(ordered)}
    assert got == want


def test_session_conf_leaves_sizing_to_the_cluster():
    from wardstat.session import session_conf

    conf = session_conf()
    assert "spark.sql.shuffle.partitions" not in conf and "spark.driver.memory" not in conf
    assert conf["spark.sql.adaptive.enabled"] == "true" and conf["spark.sql.session.timeZone"] == "UTC"
    sized = session_conf(shuffle_partitions=8, driver_memory="4g")
    assert sized["spark.sql.shuffle.partitions"] == "8" and sized["spark.driver.memory"] == "4g"


def test_numbered_owns_its_target_and_scratch_is_deleted(spark, fx, tmp_path):
    from wardstat import session

    h = fx.incidents_hourly.select("case_no", "ts")
    path = str(tmp_path / "ids")
    S.with_case_id(h, path=path).count()
    assert os.path.isdir(path)
    assert session.delete_path(spark, path) and not os.path.exists(path)
    session.drop_scratch(spark)
    S.with_case_id(h).count()
    (folder,) = session._SCRATCH[spark]
    assert os.path.isdir(folder.removeprefix("file:"))
    assert session.drop_scratch(spark) == 1 and not os.path.exists(folder.removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from wardstat.session import _LOCAL_MASTER

    assert all(_LOCAL_MASTER.match(m) for m in ("local", "local[4]", "local[*]"))
    assert not any(_LOCAL_MASTER.match(m) for m in ("local-cluster[3,2,1024]", "yarn", "spark://h:7077", "localhost"))
