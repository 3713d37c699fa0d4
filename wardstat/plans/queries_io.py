"""Registered round trips of the sinks: written to the session's scratch folder, read back.

``session.drop_scratch`` deletes what they wrote once the results are used.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstat.functions.calendar import with_calendar
from wardstat.operators import aggregates as A
from wardstat.plans import flows
from wardstat.plans.catalog import fixtures, r6, register
from wardstat.session import scratch_folder
from wardstat.sources import io as IO


@register(
    "s2_read_upload",
    """select cast(case_no as varchar) as case_no, date_text, district_text, type_text from incidents_raw""",
)
def s2_read_upload(spark, sf_dir):
    """An upload of CSV files, through the gate, as text rows."""
    path = IO.stage_csv(fixtures(spark, sf_dir).incidents_raw.select("case_no", "date_text", "district_text", "type_text"), "s2_upload")
    return IO.read_upload(spark, path)


@register("s4_write_processed", """select case_no, year(ts) as year, month(ts) as month, hour(ts) as hour, district from incidents_hourly""")
def s4_write_processed(spark, sf_dir):
    """The processed table, partitioned by year, read back."""
    path = scratch_folder(spark, "s4-processed")
    IO.write_processed(with_calendar(fixtures(spark, sf_dir).incidents_hourly), path)
    return r6(spark.read.parquet(path).select("case_no", "year", "month", "hour", "district"))


@register(
    "s5_write_aggregates",
    """
select 'daily' as name, cast(cast(ts as date) as varchar) as key, count(crime_type) as n from incidents_hourly where ts is not null group by 2
union all select 'type', district || '/' || crime_type, count(*) from incidents_hourly where district is not null and crime_type is not null group by 2""",
)
def s5_write_aggregates(spark, sf_dir):
    """Aggregates written by name, read back from their folders."""
    h = fixtures(spark, sf_dir).incidents_hourly
    daily, by_type = IO.write_aggregates({"daily": A.daily(h), "type": A.type_by_district(h)}, scratch_folder(spark, "s5-aggregates"))
    a = spark.read.parquet(daily).select(F.lit("daily").alias("name"), F.col("date").cast("string").alias("key"), F.col("daily_crimes").alias("n"))
    b = spark.read.parquet(by_type).select(F.lit("type"), F.concat_ws("/", "district", "crime_type"), "count")
    return r6(a.union(b))


_S6_SQL = """select count(*) as total_records, cast(min(cast(ts as date)) as varchar) as date_min, cast(max(cast(ts as date)) as varchar) as date_max from incidents_monthly"""


@register("s6_write_summary", _S6_SQL)
def s6_write_summary(spark, sf_dir):
    """A one-row summary as JSON, read back (dates are text there)."""
    path = scratch_folder(spark, "s6-summary")
    IO.write_summary(A.dataset_info(fixtures(spark, sf_dir).incidents_monthly).drop("columns"), path)
    return r6(spark.read.json(path).select("total_records", "date_min", "date_max"))


@register(
    "s7_p16_training_summary",
    """
select count(*) as total_records, count(distinct district) as districts, count(distinct crime_type) as crime_types,
       datediff('day', min(cast(ts as date)), max(cast(ts as date))) as span_days, 'crime_types,districts,models,span_days,total_records' as columns
from incidents_monthly""",
)
def s7_p16_training_summary(spark, sf_dir):
    """A training summary as JSON without its model and scaler columns."""
    path = scratch_folder(spark, "s7-training")
    info = flows.training_info(fixtures(spark, sf_dir).incidents_monthly)
    IO.write_training_summary(info.withColumn("model", F.lit("object")).withColumn("scaler", F.lit("object")), path)
    back = spark.read.json(path)
    return r6(back.select("total_records", "districts", "crime_types", "span_days", F.lit(",".join(back.columns)).alias("columns")))


@register("s8_s10_publish_read", """select case_no, district, crime_type, cast(2 as bigint) as versions from incidents_hourly""")
def s8_s10_publish_read(spark, sf_dir):
    """Two versions published, the second under a smaller name and with one more
    column; the current one is the one published last."""
    root = scratch_folder(spark, "s8-published")
    h = fixtures(spark, sf_dir).incidents_hourly
    IO.publish(h.select("case_no", "district"), root, "v9")
    IO.publish(h.select("case_no", "district", "crime_type"), root, "v10")
    versions = spark.read.parquet(f"{root}/_versions").agg(F.count(F.lit(1))).scalar()
    return r6(IO.read_current(spark, root).select("case_no", "district", "crime_type", versions.cast("int").alias("versions")))


@register("s9_model_round_trip", """select count(distinct district) as districts, true as same from incidents_hourly where district is not null""")
def s9_model_round_trip(spark, sf_dir):
    """A forest saved and loaded predicts the same for every district."""
    from wardstat.operators import risk as RK
    from wardstat.session import materialize
    from wardstat.sources.views import CLASS_MAP

    fx = fixtures(spark, sf_dir)
    feats = materialize(RK.risk_features(fx.incidents_hourly, fx.district_dim, CLASS_MAP))
    model = RK.train_risk(feats, num_trees=5, materialize_input=False)
    path = scratch_folder(spark, "s9-model")
    IO.save_model(model, path)
    a = RK.predict_risk(model, feats).select("district", F.col("confidence").alias("a"))
    b = RK.predict_risk(IO.load_model(path), feats).select("district", F.col("confidence").alias("b"))
    return r6(a.join(b, "district").agg(F.count(F.lit(1)).alias("districts"), F.bool_and(F.col("a") == F.col("b")).alias("same")))
