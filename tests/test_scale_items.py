"""Deduplication by fingerprints, keyed order, publishing at once and the log of a write."""

import threading

import pytest

from collected import rows
from pyspark.sql import functions as F
from wardstat.operators import clean as CL
from wardstat.operators import ordering as L
from wardstat.operators import quality as G
from wardstat.plans import flows
from wardstat.sources import io as IO


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [27, 15])
def test_wide_dedup_is_distinct(spark, bits):
    df = spark.range(3000).select((F.col("id") % 1700).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 1700).cast("string").alias("odd.name"), F.array(F.col("id") % 1700).alias("c"))
    df = df.unionByName(df.limit(0)).repartition(5)
    got = CL.dedup_wide(df, bits)
    assert got.columns == df.columns and sorted(rows(got), key=str) == sorted(rows(df.distinct()), key=str)
    nulls = spark.createDataFrame([(None, None), (1, None), (None, None), (1, "x"), (1, "x")], "a int, b string")
    assert sorted(rows(CL.dedup_wide(nulls)), key=str) == sorted([(None, None), (1, None), (1, "x")], key=str)
    assert rows(CL.dedup_wide(nulls.where("false"))) == []


def test_unique_wide_rows_are_not_exchanged(spark, tmp_path):
    """The wide column crosses an exchange for the rows with copies only."""
    df = spark.range(4000).select("id", F.repeat(F.lit("x"), 50).alias("wide"))
    df.unionByName(df.where("id < 10")).write.parquet(str(tmp_path / "t"))
    got = CL.dedup_wide(spark.read.parquet(str(tmp_path / "t")))
    assert got.count() == 4000
    out = got._jdf.queryExecution()
    got.collect()
    text = out.executedPlan().toString()
    union = text.index("Union")
    kept, copied = text[union:].split("HashAggregate(keys=[id", 1) if "HashAggregate(keys=[id" in text[union:] else (text[union:], "")
    assert "Exchange hashpartitioning(id" not in kept.split("BroadcastHashJoin")[0]
    # rows written by shuffles: narrow counts of all rows, whole rows of the twenty that have a copy
    exchanged = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "wide" in line]
    assert exchanged and all("wide" in line for line in exchanged)
    held = spark.read.parquet(str(tmp_path / "t"))
    marks = held.groupBy("id", "wide").count().where("count > 1").count()
    assert marks == 10


def test_permutation_is_a_bijection_and_seeded(spark):
    n = spark.range(1 << 8).select("id", L.permuted(F.col("id"), 1, 4).alias("p"), L.permuted(F.col("id"), 2, 4).alias("q"))
    got = rows(n)
    assert sorted(r[1] for r in got) == list(range(256)) == sorted(r[2] for r in got)
    assert sum(r[1] != r[2] for r in got) > 200 and sum(r[0] == r[1] for r in got) < 20
    wide = spark.range(0, 1 << 60, 1 << 50).select(L.permuted(F.col("id"), 5, 30).alias("p"))
    assert len({r[0] for r in wide.collect()}) == 1 << 10  # no product leaves a long


def test_keyed_order_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 3)
    first = [r["id"] for r in L.shuffle_by_key(df.repartition(4), "id").collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = [r["id"] for r in L.shuffle_by_key(df.repartition(9), "id").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert first == again and sorted(first) == list(range(500)) and first != list(range(500))
    moved = sum(abs(p - i) > 50 for p, i in enumerate(first))
    assert moved > 300
    assert [r["id"] for r in L.shuffle_by_key(df, "id", seed=7).collect()] != first


def test_two_publishers_take_different_numbers(spark, tmp_path, monkeypatch):
    """Both read the same last number and claim the same next one; one of them must go on."""
    root = str(tmp_path / "published")
    IO.publish(spark.range(1), root, "first")
    both = threading.Barrier(2)
    real = IO._next_commit

    def same(s, r):
        n = real(s, r)
        both.wait(60)
        return n

    monkeypatch.setattr(IO, "_next_commit", same)
    errors = []

    def run(v, n):
        try:
            IO.publish(spark.range(n), root, v)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=a) for a in (("zz", 5), ("aa", 7))]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert not errors
    log = {r["version"]: r["commit"] for r in spark.read.parquet(root + "/_versions").collect()}
    assert log["first"] == 1 and sorted(log.values()) == [1, 2, 3]
    last = max(log, key=log.get)
    assert IO.current_version(spark, root) == last and IO.read_current(spark, root).count() == {"zz": 5, "aa": 7}[last]
    assert not IO.claim(spark, f"{root}/_commits/{2:012d}", "late") and IO.claim(spark, f"{root}/_commits/{9:012d}", "new")


def test_log_of_the_write_is_the_log(spark, tmp_path):
    raw = [("2024-01-01", " a", "x", 1.0, 2.0), ("2024-01-01", " a", "x", 1.0, 2.0), ("bad", "b", "x", 1.0, 2.0), ("2024-01-03", None, None, None, 2.0), ("2024-01-04", "c", "y", 1.0, 2.0)]
    df = spark.createDataFrame(raw, "date string, district string, crime_type string, latitude double, longitude double")
    processed, aggs, log = flows.preprocess_logged(df, str(tmp_path))
    want = sorted(rows(G.processing_log(df)))
    assert sorted(rows(log)) == want
    assert processed.count() == 3 and {r["district"] for r in processed.collect()} == {"A", "Unknown", "C"}
    plain, plain_aggs = flows.preprocess(df)
    # the session has observed now: forests still predict and cross-validate
    from wardstat.operators import risk as RK

    feats = spark.createDataFrame([(f"d{i}", *[float((i * k) % 17) for k in range(1, 9)]) for i in range(30)], ["district", *RK.FEATURES])
    assert RK.predict_risk(RK.train_risk(feats, num_trees=2), feats).count() == 30
    assert 0 <= RK.cross_validate_risk(spark, feats, 2, 2).first()[1] <= 1
    assert sorted(rows(aggs["daily"]), key=str) == sorted(rows(plain_aggs["daily"]), key=str)
