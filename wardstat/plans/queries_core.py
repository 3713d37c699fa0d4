"""Registered queries: scalar families, cleaning, lookups, aggregates, ordering, gates.

Oracles are DuckDB SQL over the same fixture views (prefixed as CTEs by
``register``); ``title_sql``/``parse_sql`` give the DuckDB forms of R1 and R3.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstat.functions import calendar as C
from wardstat.functions import numeric as N
from wardstat.functions import text as T
from wardstat.functions.payload import as_json, map_of, ordered_points
from wardstat.operators import aggregates as A
from wardstat.operators import clean as CL
from wardstat.operators import ordering as L
from wardstat.operators import quality as G
from wardstat.operators.lookups import with_district_dim, with_severity
from wardstat.operators.series import numbered, with_case_id
from wardstat.plans.catalog import fixtures, r6, register
from wardstat.sources import io as IO

# DuckDB form of R1 (strip + title case); {s} is the argument.
_TITLE = (
    "array_to_string(list_transform(regexp_extract_all(lower(regexp_replace({s}, '^\\s+|\\s+$', '', 'g')), "
    "'\\p{{L}}+|\\P{{L}}+'), lambda x: upper(x[1]) || x[2:]), '')"
)


def title_sql(s: str) -> str:
    return _TITLE.format(s=s)


_PARSE = (
    "coalesce(try_cast({s} as timestamp), try_strptime({s}, '%m/%d/%Y'), try_strptime({s}, '%d/%m/%Y'))"
)


def parse_sql(s: str) -> str:
    return _PARSE.format(s=s)


# Raw view with the original application's header spellings (exercise P1).
_RAW_HEADERS = {"date_text": "Date", "district_text": "DISTRICT", "type_text": "Crime Type", "latitude": "LAT", "longitude": "LNG"}


def raw_with_headers(fx):
    return fx.incidents_raw.withColumnsRenamed(_RAW_HEADERS)


def cleaned(fx, null_type="Other"):
    return CL.clean_incidents(raw_with_headers(fx), null_type=null_type)


_CLEAN_SQL = f"""
select distinct case_no, ts, coalesce(district, 'Unknown') as district, coalesce(crime_type, 'Other') as crime_type,
       latitude, longitude
from (select case_no, {parse_sql('date_text')} as ts, {title_sql('district_text')} as district,
             {title_sql('type_text')} as crime_type, latitude, longitude
      from incidents_raw) x
where ts is not null
"""

# ------------------------------------------------------------------ scalars ---


@register(
    "r_text",
    f"""
select case_no, {title_sql('district_text')} as title_district,
       {title_sql("replace(district_text, '-', ' ')")} as slug_district,
       cast(case_no as varchar) as case_text, upper(type_text) as type_upper,
       contains(district_text, 'zone') as has_zone
from incidents_raw""",
)
def r_text(spark, sf_dir):
    raw = fixtures(spark, sf_dir).incidents_raw
    return r6(
        raw.select(
            "case_no",
            T.strip_title("district_text").alias("title_district"),
            T.district_from_slug("district_text").alias("slug_district"),
            T.as_text("case_no").alias("case_text"),
            T.upper_name("type_text").alias("type_upper"),
            T.has_substring("district_text", "zone").alias("has_zone"),
        )
    )


@register(
    "r_calendar",
    """
select case_no, year(ts) as year, month(ts) as month, day(ts) as day, hour(ts) as hour,
       isodow(ts) - 1 as day_of_week, dayname(ts) as day_name, monthname(ts) as month_name,
       cast(date_trunc('month', ts) as date) as year_month, strftime(ts, '%Y-%m') as ym_text,
       concat_ws('-', cast(year(ts) as varchar), lpad(cast(month(ts) as varchar), 2, '0')) as month_key,
       quarter(ts) as quarter,
       case when hour(ts) <= 6 then 'Night' when hour(ts) <= 12 then 'Morning'
            when hour(ts) <= 18 then 'Afternoon' else 'Evening' end as time_of_day,
       cast(ts as date) as date, strftime(ts, '%Y-%m-%d') as date_text, strftime(ts, '%H:%M:%S') as time_text,
       strftime(ts, '%Y-%m-%d %H:%M:%S') as datetime_text,
       cast(ts as date) + 7 as plus_7_days, cast(cast(ts as date) + interval 1 month as date) as plus_1_month,
       printf('CASE_%06d', case_no) as case_id,
       case when month(ts) in (4, 5, 6) then 'Summer' when month(ts) in (11, 12, 1) then 'Winter'
            when month(ts) in (7, 8, 9) then 'Monsoon' else 'Spring' end as season,
       isodow(ts) in (6, 7) as is_weekend
from incidents_hourly""",
)
def r_calendar(spark, sf_dir):
    h = fixtures(spark, sf_dir).incidents_hourly
    f = C.with_calendar(h)
    return r6(
        f.select(
            "case_no", "year", "month", "day", "hour", "day_of_week", "day_name", "month_name", "year_month",
            C.month_text("ts").alias("ym_text"),
            C.month_key("year", "month").alias("month_key"),
            "quarter", "time_of_day",
            F.to_date("ts").alias("date"),
            C.date_text("ts").alias("date_text"),
            C.time_text("ts").alias("time_text"),
            C.datetime_text("ts").alias("datetime_text"),
            C.add_days(F.to_date("ts"), 7).alias("plus_7_days"),
            C.add_months(F.to_date("ts"), 1).alias("plus_1_month"),
            C.padded_id("CASE_", "case_no").alias("case_id"),
            C.season("month").alias("season"),
            "is_weekend",
        )
    )


@register(
    "r_parse",
    f"""
select case_no, {parse_sql('iso')} as p_iso, {parse_sql('us')} as p_us, {parse_sql('eu')} as p_eu,
       {parse_sql('full_text')} as p_full, {parse_sql('junk')} as p_junk
from (select case_no, strftime(ts, '%Y-%m-%d') as iso, strftime(ts, '%m/%d/%Y') as us,
             strftime(ts, '%d/%m/%Y') as eu, strftime(ts, '%Y-%m-%d %H:%M:%S') as full_text,
             'day ' || cast(case_no as varchar) as junk
      from incidents_hourly) t""",
)
def r_parse(spark, sf_dir):
    h = fixtures(spark, sf_dir).incidents_hourly
    t = h.select(
        "case_no",
        F.date_format("ts", "yyyy-MM-dd").alias("iso"),
        F.date_format("ts", "MM/dd/yyyy").alias("us"),
        F.date_format("ts", "dd/MM/yyyy").alias("eu"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("full_text"),
        F.concat(F.lit("day "), F.col("case_no").cast("string")).alias("junk"),
    )
    return r6(
        t.select(
            "case_no",
            *[C.parse_datetime(c).alias(f"p_{n}") for c, n in (("iso", "iso"), ("us", "us"), ("eu", "eu"), ("full_text", "full"), ("junk", "junk"))],
        )
    )


@register(
    "r4_strict_parse",
    """select case_no, cast(strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp) as ts_strict from incidents_hourly""",
)
def r4_strict_parse(spark, sf_dir):
    """R4 after gate G3: every text is well-formed, so the strict cast is safe."""
    h = fixtures(spark, sf_dir).incidents_hourly
    t = h.select("case_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("txt"))
    return r6(t.select("case_no", C.parse_datetime_strict("txt").alias("ts_strict")))


@register(
    "r_numeric",
    """
select case_no, round(latitude, 4) as lat4,
       case when latitude is null then null else least(greatest(latitude, 28.5e0), 28.7e0) end as lat_clamped,
       abs(latitude - 28.6e0) as lat_dev, cast(floor(longitude * 10) as bigint) as lon_tenths,
       round((case_no % 24) / 24e0 * 100e0, 1) as pct1, coalesce(latitude, 0e0) as lat_or_zero
from incidents_raw""",
)
def r_numeric(spark, sf_dir):
    raw = fixtures(spark, sf_dir).incidents_raw
    return r6(
        raw.select(
            "case_no",
            N.round_to("latitude", 4).alias("lat4"),
            N.clamp("latitude", 28.5, 28.7).alias("lat_clamped"),
            N.abs_error("latitude", F.lit(28.6)).alias("lat_dev"),
            N.trunc_int(F.col("longitude") * 10).cast("long").alias("lon_tenths"),
            N.pct1((F.col("case_no") % 24) / 24.0).alias("pct1"),
            N.fallback("latitude", 0.0).alias("lat_or_zero"),
        )
    )


@register(
    "r_payload",
    """
select state, cast(to_json(struct_pack(state := state,
         counts := map_from_entries(list(struct_pack(k := district, v := n) order by district)),
         points := list(struct_pack(district := district, n := n) order by district))) as varchar) as payload
from (select state, district, count(*) as n from incidents_hourly group by 1, 2) t group by state""",
)
def r_payload(spark, sf_dir):
    """Per state, a map of district counts (R24) and the ordered list of
    (district, count) points (R25), serialised as one JSON payload (R26)."""
    h = fixtures(spark, sf_dir).incidents_hourly
    per = h.groupBy("state", "district").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("state").agg(map_of("district", "n").alias("counts"), ordered_points("district", "n").alias("points"))
    return g.select("state", as_json("state", "counts", "points").alias("payload"))


# ----------------------------------------------------------------- sources ---


@register(
    "s3_probe",
    """
select count(*) as n_rows, 'case_no,date_text,district_text,type_text,latitude,longitude' as columns from incidents_raw""",
)
def s3_probe(spark, sf_dir):
    return r6(IO.probe(fixtures(spark, sf_dir).incidents_raw))


@register(
    "s1_read_incidents",
    """
select cast(case_no as varchar) as case_no, date_text as "Date", district_text as "DISTRICT", type_text as "Crime Type",
       cast(latitude as varchar) as "LAT", cast(longitude as varchar) as "LNG"
from incidents_raw""",
)
def s1_read_incidents(spark, sf_dir):
    """The raw view written as CSV to the shared scratch folder, read back
    through the incident reader with its original header names (all text)."""
    fx = fixtures(spark, sf_dir)
    path = IO.stage_csv(raw_with_headers(fx), "s1_raw_csv")
    return IO.read_incidents(spark, path, fmt="csv")


# ---------------------------------------------------------------- cleaning ---


@register(
    "p1_canonical_columns",
    """
select case_no, date_text as date, district_text as district, type_text as crime_type, latitude, longitude
from incidents_raw""",
)
def p1_canonical_columns(spark, sf_dir):
    return r6(CL.canonical_columns(raw_with_headers(fixtures(spark, sf_dir))))


@register(
    "p2_if_has",
    """select case_no, coalesce(district_text, 'Unknown') as district_text from incidents_raw""",
)
def p2_if_has(spark, sf_dir):
    """A step runs only where its columns exist: the fill does, the drop on an absent column doesn't."""
    raw = fixtures(spark, sf_dir).incidents_raw.select("case_no", "district_text")
    filled = CL.if_has(raw, "district_text", lambda d: d.fillna("Unknown", ["district_text"]))
    return r6(CL.if_has(filled, ["district_text", "absent"], lambda d: d.limit(0)))


@register(
    "p3_drop_undated",
    f"""select case_no, ts from (select case_no, {parse_sql('date_text')} as ts from incidents_raw) x where ts is not null""",
)
def p3_drop_undated(spark, sf_dir):
    raw = fixtures(spark, sf_dir).incidents_raw
    return r6(CL.drop_undated(CL.parse_dates(raw, "date_text", "ts")).select("case_no", "ts"))


@register(
    "p4_fill_district",
    f"""select case_no, coalesce({title_sql('district_text')}, 'Unknown') as district from incidents_raw""",
)
def p4_fill_district(spark, sf_dir):
    raw = fixtures(spark, sf_dir).incidents_raw
    d = raw.select("case_no", T.strip_title("district_text").alias("district"))
    return r6(CL.fill_district(d))


@register(
    "p5_fill_type",
    f"""select case_no, coalesce({title_sql('type_text')}, 'General Crime') as crime_type from incidents_raw""",
)
def p5_fill_type(spark, sf_dir):
    raw = fixtures(spark, sf_dir).incidents_raw
    d = raw.select("case_no", T.strip_title("type_text").alias("crime_type"))
    return r6(CL.fill_type(d, "General Crime"))


@register(
    "p6_missing_coordinates",
    """select count(*) as missing_coordinates from incidents_raw where latitude is null or longitude is null""",
)
def p6_missing_coordinates(spark, sf_dir):
    raw = fixtures(spark, sf_dir).incidents_raw
    return r6(CL.missing_coordinates(raw).agg(F.count(F.lit(1)).alias("missing_coordinates")))


@register("p7_weekend", """select case_no, isodow(ts) in (6, 7) as is_weekend from incidents_hourly""")
def p7_weekend(spark, sf_dir):
    h = fixtures(spark, sf_dir).incidents_hourly
    return r6(h.select("case_no", C.is_weekend("ts").alias("is_weekend")))


@register("p8_for_district", """select case_no, ts, district from incidents_hourly where district = 'Zone 7'""")
def p8_for_district(spark, sf_dir):
    h = fixtures(spark, sf_dir).incidents_hourly
    return r6(CL.for_district(h, "Zone 7").select("case_no", "ts", "district"))


@register(
    "p9_district_from_slug",
    f"""select case_no, district_text, {title_sql("replace(district_text, '-', ' ')")} as district from incidents_raw""",
)
def p9_district_from_slug(spark, sf_dir):
    raw = fixtures(spark, sf_dir).incidents_raw
    return r6(raw.select("case_no", "district_text", T.district_from_slug("district_text").alias("district")))


@register(
    "p10_type_matches",
    """select crime_type, count(*) as n from incidents_hourly where regexp_matches(crime_type, 'click|view') group by 1""",
)
def p10_type_matches(spark, sf_dir):
    h = fixtures(spark, sf_dir).incidents_hourly
    return r6(CL.type_matches(h, "click|view").groupBy("crime_type").agg(F.count(F.lit(1)).alias("n")))


@register(
    "p11_date_like_columns",
    """
select cast(7 as bigint) as ordinal, 'year' as column_name, count(year(ts)) as non_null from incidents_hourly
union all select 8, 'month', count(month(ts)) from incidents_hourly
union all select 13, 'month_name', count(monthname(ts)) from incidents_hourly
union all select 14, 'year_month', count(date_trunc('month', ts)) from incidents_hourly""",
)
def p11_date_like_columns(spark, sf_dir):
    """Date-like columns of the processed incident table, with non-null counts."""
    return r6(CL.date_like_columns(spark, C.with_calendar(fixtures(spark, sf_dir).incidents_hourly)))


@register(
    "p12_season",
    """
select distinct month(ts) as month,
       case when month(ts) in (4, 5, 6) then 'Summer' when month(ts) in (11, 12, 1) then 'Winter'
            when month(ts) in (7, 8, 9) then 'Monsoon' else 'Spring' end as season
from incidents_monthly""",
)
def p12_season(spark, sf_dir):
    m = fixtures(spark, sf_dir).incidents_monthly
    return r6(m.select(F.month("ts").alias("month")).distinct().withColumn("season", C.season("month")))


@register(
    "p15_describe_schema",
    """
select cast(0 as bigint) as ordinal, 'case_no' as column_name, 'bigint' as data_type, true as nullable, count(case_no) as non_null
from incidents_raw
union all select 1, 'date_text', 'string', true, count(date_text) from incidents_raw
union all select 2, 'district_text', 'string', true, count(district_text) from incidents_raw
union all select 3, 'type_text', 'string', true, count(type_text) from incidents_raw
union all select 4, 'latitude', 'double', true, count(latitude) from incidents_raw
union all select 5, 'longitude', 'double', true, count(longitude) from incidents_raw""",
)
def p15_describe_schema(spark, sf_dir):
    """Schema report of the raw incident view, with non-null counts."""
    return r6(CL.describe_schema(spark, fixtures(spark, sf_dir).incidents_raw))


@register("e1_dedup", """select distinct * from incidents_raw""")
def e1_dedup(spark, sf_dir):
    return r6(CL.dedup(fixtures(spark, sf_dir).incidents_raw))


@register("f1_clean_incidents", _CLEAN_SQL)
def f1_clean_incidents(spark, sf_dir):
    """The whole cleaning flow (P1, R3, R1, P3, P4, P5, E1) on the raw view."""
    return r6(cleaned(fixtures(spark, sf_dir)))


@register("e2_new_values", """select c_custkey as custkey from customer except select o_custkey from orders""")
def e2_new_values(spark, sf_dir):
    """Values of one table that another lacks (customers without an order)."""
    fx = fixtures(spark, sf_dir)
    new = fx.table("customer").select(F.col("c_custkey").alias("custkey"))
    return r6(CL.new_values(new, fx.table("orders").select(F.col("o_custkey").alias("custkey")), "custkey"))


# ------------------------------------------------------------------ lookups ---


@register(
    "j1_with_severity",
    """select h.case_no, h.crime_type, s.crime_severity from incidents_hourly h left join severity_dim s on h.crime_type = s.crime_type""",
)
def j1_with_severity(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return r6(with_severity(fx.incidents_hourly.select("case_no", "crime_type"), fx.severity_dim))


@register(
    "j2_with_district_dim",
    """select h.case_no, h.district, d.state, d.lat, d.lon, cast(d.population as bigint) as population
from incidents_hourly h left join district_dim d on h.district = d.district""",
)
def j2_with_district_dim(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return r6(with_district_dim(fx.incidents_hourly.select("case_no", "district"), fx.district_dim))


# --------------------------------------------------------------- aggregates ---
_A1_SQL = """
select cast(date_trunc('month', ts) as date) as year_month, district,
       count(crime_type) as total_crimes,
       count(distinct crime_type) as unique_crime_types,
       cast(sum(case when isodow(ts) in (6, 7) then 1 else 0 end) as bigint) as weekend_crimes,
       round(avg(hour(ts)), 6) as avg_hour,
       round(stddev_samp(hour(ts)), 6) as hour_std
from {view} where ts is not null and district is not null
group by 1, 2
"""


@register("a1_monthly_district", _A1_SQL.format(view="incidents_monthly"))
def a1_monthly_district(spark, sf_dir):
    return r6(A.monthly_district(C.with_calendar(fixtures(spark, sf_dir).incidents_monthly)))


@register("a1_monthly_district_hourly", _A1_SQL.format(view="incidents_hourly"))
def a1_monthly_district_hourly(spark, sf_dir):
    return r6(A.monthly_district(C.with_calendar(fixtures(spark, sf_dir).incidents_hourly)))


@register(
    "a3_daily",
    """
select cast(ts as date) as date, count(crime_type) as daily_crimes, count(distinct district) as districts_affected
from incidents_hourly where ts is not null group by 1""",
)
def a3_daily(spark, sf_dir):
    return r6(A.daily(fixtures(spark, sf_dir).incidents_hourly))


@register(
    "a4_type_by_district",
    """select district, crime_type, count(*) as count from incidents_hourly
where district is not null and crime_type is not null group by 1, 2""",
)
def a4_type_by_district(spark, sf_dir):
    return r6(A.type_by_district(fixtures(spark, sf_dir).incidents_hourly))


_MONTHLY_ALL = """select cast(date_trunc('month', ts) as date) as month, count(*) as crime_count
from incidents_monthly where ts is not null group by 1"""


@register("a5_monthly_all", _MONTHLY_ALL)
def a5_monthly_all(spark, sf_dir):
    return r6(A.monthly_all(fixtures(spark, sf_dir).incidents_monthly))


@register(
    "a7_month_coverage",
    """
select district, count(distinct cast(date_trunc('month', ts) as date)) as months,
       min(cast(date_trunc('month', ts) as date)) as first_month, max(cast(date_trunc('month', ts) as date)) as last_month
from incidents_monthly where district is not null and ts is not null group by 1""",
)
def a7_month_coverage(spark, sf_dir):
    return r6(A.month_coverage(fixtures(spark, sf_dir).incidents_monthly))


@register(
    "a8_first_last_month",
    f"""
select min(month) as first_month, min_by(crime_count, month) as first_count,
       max(month) as last_month, max_by(crime_count, month) as last_count
from ({_MONTHLY_ALL}) m""",
)
def a8_first_last_month(spark, sf_dir):
    return r6(A.first_last_month(A.monthly_all(fixtures(spark, sf_dir).incidents_monthly)))


def _ranked_sql(col):
    return f"""select {col}, count, row_number() over (order by count desc, {col}) as position
from (select {col}, count(*) as count from incidents_hourly where {col} is not null group by 1) t"""


@register("a9_district_counts", _ranked_sql("district"))
def a9_district_counts(spark, sf_dir):
    return r6(A.with_rank(A.district_counts(fixtures(spark, sf_dir).incidents_hourly), "district"))


@register("a10_type_counts", _ranked_sql("crime_type"))
def a10_type_counts(spark, sf_dir):
    return r6(A.with_rank(A.type_counts(fixtures(spark, sf_dir).incidents_hourly), "crime_type"))


@register(
    "a11_dataset_info",
    """select count(*) as total_records, min(cast(ts as date)) as date_min, max(cast(ts as date)) as date_max,
       'case_no,ts,district,state,crime_type' as columns from incidents_monthly""",
)
def a11_dataset_info(spark, sf_dir):
    return r6(A.dataset_info(fixtures(spark, sf_dir).incidents_monthly))


@register("a12_distinct_districts", """select distinct district from incidents_hourly where district is not null""")
def a12_distinct_districts(spark, sf_dir):
    return r6(A.distinct_values(fixtures(spark, sf_dir).incidents_hourly, "district"))


@register("a12_distinct_types", """select distinct crime_type from incidents_monthly where crime_type is not null""")
def a12_distinct_types(spark, sf_dir):
    return r6(A.distinct_values(fixtures(spark, sf_dir).incidents_monthly, "crime_type"))


@register(
    "a13_cardinalities",
    """select count(distinct district) as unique_districts, count(distinct crime_type) as unique_crime_types from incidents_monthly""",
)
def a13_cardinalities(spark, sf_dir):
    return r6(A.cardinalities(fixtures(spark, sf_dir).incidents_monthly))


@register(
    "a14_missing_values",
    """
select * from (values
  ('case_no', (select count(*) from incidents_raw where case_no is null)),
  ('date_text', (select count(*) from incidents_raw where date_text is null)),
  ('district_text', (select count(*) from incidents_raw where district_text is null)),
  ('type_text', (select count(*) from incidents_raw where type_text is null)),
  ('latitude', (select count(*) from incidents_raw where latitude is null)),
  ('longitude', (select count(*) from incidents_raw where longitude is null))) t(column_name, missing)""",
)
def a14_missing_values(spark, sf_dir):
    return r6(A.missing_values(fixtures(spark, sf_dir).incidents_raw))


@register(
    "a15_date_range_days",
    """select datediff('day', min(cast(ts as date)), max(cast(ts as date))) as span_days from incidents_monthly""",
)
def a15_date_range_days(spark, sf_dir):
    return r6(A.date_range_days(fixtures(spark, sf_dir).incidents_monthly))


_A16_COLUMNS = ("case_no", "ts", "district", "crime_type", "latitude", "longitude")


@register(
    "a16_data_summary",
    f"""
with c as (select * from ({_CLEAN_SQL}) x)
select column_name, ordinal, missing, total_records, date_min, date_max, unique_districts, unique_crime_types, date '2024-06-30' as processing_date
from (values """
    + ", ".join(f"('{c}', cast({i} as bigint), (select count(*) from c where {c} is null))" for i, c in enumerate(_A16_COLUMNS))
    + """) v(column_name, ordinal, missing),
     (select count(*) as total_records, min(cast(ts as date)) as date_min, max(cast(ts as date)) as date_max,
             count(distinct district) as unique_districts, count(distinct crime_type) as unique_crime_types from c) s""",
)
def a16_data_summary(spark, sf_dir):
    """Processing summary of the cleaned raw view, a row for each column of its list."""
    s = A.data_summary(cleaned(fixtures(spark, sf_dir)).select(*_A16_COLUMNS), processed_on="2024-06-30")
    rows = s.select("*", F.posexplode("columns").alias("ordinal", "column_name"))
    return r6(
        rows.select(
            "column_name", "ordinal", F.element_at("missing_values", F.col("column_name")).alias("missing"), "total_records",
            F.col("date_range.start").alias("date_min"), F.col("date_range.end").alias("date_max"),
            "unique_districts", "unique_crime_types", "processing_date",
        )
    )


@register(
    "a17_upload_quality",
    f"""
select o.n as original_records, d.n as processed_records, o.n - d.n as duplicates_removed, u.n as undated_records,
       case when o.n > 0 then round(d.n / o.n * 100e0, 6) else 100e0 end as data_quality_pct
from (select count(*) as n from incidents_raw) o,
     (select count(*) as n from (select distinct * from incidents_raw) x) d,
     (select count(*) as n from incidents_raw where {parse_sql('date_text')} is null) u""",
)
def a17_upload_quality(spark, sf_dir):
    return r6(A.upload_quality(fixtures(spark, sf_dir).incidents_raw, "date_text"))


# ---------------------------------------------------------------- ordering ---


@register("l1_by_time", """select case_no, ts, district, row_number() over (order by ts, case_no) as position from incidents_hourly""")
def l1_by_time(spark, sf_dir):
    """L1 with the place of each row as a column (the comparison ignores row order)."""
    h = fixtures(spark, sf_dir).incidents_hourly
    return r6(numbered(h.select("case_no", "ts", "district"), "ts", "case_no"))


def _topk_sql(col, k, view="incidents_hourly"):
    return f"""select {col}, count(*) as count from {view} where {col} is not null group by 1
order by count desc, {col} limit {k}"""


@register("l2_top_districts", _topk_sql("district", 5))
def l2_top_districts(spark, sf_dir):
    return r6(L.top_districts(fixtures(spark, sf_dir).incidents_hourly, 5))


@register("l2_top_types", _topk_sql("crime_type", 5, "incidents_monthly"))
def l2_top_types(spark, sf_dir):
    return r6(L.top_types(fixtures(spark, sf_dir).incidents_monthly, 5))


@register("l3_top_districts_10", _topk_sql("district", 10))
def l3_top_districts_10(spark, sf_dir):
    return r6(L.top_districts(fixtures(spark, sf_dir).incidents_hourly, 10))


@register("l4_preview", """select * from incidents_hourly order by case_no limit 5""")
def l4_preview(spark, sf_dir):
    return r6(L.preview(fixtures(spark, sf_dir).incidents_hourly, 5))


@register(
    "l5_sample_values",
    """
with h as (select * from incidents_hourly order by case_no limit 10)
select case_no, 'ts' as column_name, cast(ts as varchar) as value from h
union all select case_no, 'year_month', cast(cast(date_trunc('month', ts) as date) as varchar) from h
union all select case_no, 'month', cast(month(ts) as varchar) from h
union all select case_no, 'year', cast(year(ts) as varchar) from h""",
)
def l5_sample_values(spark, sf_dir):
    """First 10 values (as text) of each date-like column, in key order."""
    f = C.with_calendar(fixtures(spark, sf_dir).incidents_hourly)
    return L.sample_values(f, ["ts", "year_month", "month", "year"], 10)


@register(
    "l7_shuffle_rows",
    """select count(*) as n_rows, count(distinct case_no) as n_keys, true as mostly_moved,
       cast(sum(hash(district, crime_type) % 1000) * 0 as bigint) as lost from incidents_hourly""",
)
def l7_shuffle_rows(spark, sf_dir):
    """Random order of the whole table, as a measure: every row is kept once, no value
    changes (rows lost or altered against the table), and most rows moved."""
    h = fixtures(spark, sf_dir).incidents_hourly
    shuffled = L.shuffle_rows(h, 42)
    lost = h.exceptAll(shuffled).agg(F.count(F.lit(1)).alias("lost")).scalar()
    check = L.order_check(h, shuffled)
    return r6(check.select("n_rows", "n_keys", (F.col("moved") * 2 > F.col("n_rows")).alias("mostly_moved"), lost.alias("lost")))


@register(
    "w6_case_id",
    """select case_no, printf('CASE_%06d', row_number() over (order by ts, case_no)) as case_id from incidents_hourly""",
)
def w6_case_id(spark, sf_dir):
    h = fixtures(spark, sf_dir).incidents_hourly
    return r6(with_case_id(h.select("case_no", "ts")).select("case_no", "case_id"))


# ------------------------------------------------------------------- gates ---
_G_COLS = "check, subject, ok, observed, threshold, severity"


@register(
    "g2_min_rows",
    f"""select 'min_rows' as check, '*' as subject, count(*) >= 100 as ok, cast(count(*) as double) as observed,
       100e0 as threshold, 'error' as severity from incidents_hourly""",
)
def g2_min_rows(spark, sf_dir):
    return r6(G.min_rows(fixtures(spark, sf_dir).incidents_hourly))


_G3_SQL = f"""select 'dates_parse' as check, '*' as subject, count(*) filter (where date_text is not null and {parse_sql('date_text')} is null) = 0 as ok,
       cast(count(*) filter (where date_text is not null and {parse_sql('date_text')} is null) as double) as observed,
       0e0 as threshold, 'error' as severity from incidents_raw"""


@register("g3_dates_parse", _G3_SQL)
def g3_dates_parse(spark, sf_dir):
    return r6(G.dates_parse(fixtures(spark, sf_dir).incidents_raw, "date_text"))


_G4_SQL = """select 'date_span' as check, '*' as subject,
       datediff('day', min(cast(ts as date)), max(cast(ts as date))) >= 365 as ok,
       cast(datediff('day', min(cast(ts as date)), max(cast(ts as date))) as double) as observed,
       365e0 as threshold, 'warning' as severity from {view}"""


@register("g4_span_warning", _G4_SQL.format(view="incidents_hourly"))
def g4_span_warning(spark, sf_dir):
    return r6(G.span_warning(fixtures(spark, sf_dir).incidents_hourly))


@register(
    "g5_months_per_district",
    """select 'min_months' as check, district as subject, count(distinct cast(date_trunc('month', ts) as date)) >= 24 as ok,
       cast(count(distinct cast(date_trunc('month', ts) as date)) as double) as observed, 24e0 as threshold, 'warning' as severity
from incidents_monthly where district is not null and ts is not null group by district""",
)
def g5_months_per_district(spark, sf_dir):
    return r6(G.months_per_district(fixtures(spark, sf_dir).incidents_monthly))


@register(
    "g6_validation_report",
    f"""
with g as (
  select 'required_columns' as check, 'error' as severity, true as ok
  union all select 'min_rows', 'error', (select count(*) >= 100 from incidents_raw)
  union all select g3."check", severity, ok from ({_G3_SQL}) g3
  union all select 'date_span', 'warning',
         (select datediff('day', min(cast({parse_sql('date_text')} as date)), max(cast({parse_sql('date_text')} as date))) >= 365
          from incidents_raw)
)
select count(*) filter (where not ok and severity = 'error') = 0 as valid,
       coalesce(string_agg("check", ',' order by "check") filter (where not ok and severity = 'error'), '') as errors,
       coalesce(string_agg("check", ',' order by "check") filter (where not ok and severity = 'warning'), '') as warnings
from g""",
)
def g6_validation_report(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    raw = CL.canonical_columns(raw_with_headers(fx))
    gates = G.table_gates(raw, "date")
    rep = G.validation_report(gates)
    return r6(rep.select("valid", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings")))


_LOG_SQL = f"""
with x as (select {parse_sql('date_text')} as ts, district_text as district, type_text as crime_type, latitude, longitude, count(*) as n
           from incidents_raw group by case_no, date_text, district_text, type_text, latitude, longitude),
c as (select * from ({_CLEAN_SQL}) y),
t as (select (select count(*) from incidents_raw) as loaded, (select coalesce(sum(n), 0) from x where ts is not null) as dated,
             (select count(*) from c) as kept,
             (select coalesce(sum(n), 0) from x where ts is not null and district is null) as no_district,
             (select coalesce(sum(n), 0) from x where ts is not null and crime_type is null) as no_type,
             (select coalesce(sum(n), 0) from x where ts is not null and (latitude is null or longitude is null)) as no_place)
"""


@register(
    "g7_processing_log",
    _LOG_SQL
    + """
select step, cast(step_no as bigint) as step_no, cast(rows_in as bigint) as rows_in, cast(rows_out as bigint) as rows_out, cast(changed as bigint) as changed from (
  select 'load' as step, 1 as step_no, loaded as rows_in, loaded as rows_out, 0 as changed from t
  union all select 'drop_undated', 2, loaded, dated, loaded - dated from t
  union all select 'fill_district', 3, dated, dated, no_district from t
  union all select 'fill_type', 4, dated, dated, no_type from t
  union all select 'flag_coordinates', 5, dated, dated, no_place from t
  union all select 'deduplicate', 6, dated, kept, dated - kept from t) u""",
)
def g7_processing_log(spark, sf_dir):
    raw = CL.canonical_columns(raw_with_headers(fixtures(spark, sf_dir)))
    return r6(G.processing_log(raw, "date"))


@register(
    "g8_dataset_statistics",
    f"""
select count(*) as total_records, min(cast(ts as date)) as date_min, max(cast(ts as date)) as date_max,
       count(distinct district) as unique_districts, count(distinct crime_type) as unique_crime_types,
       count(*) filter (where case_no is null) + count(*) filter (where ts is null) + count(*) filter (where district is null)
       + count(*) filter (where crime_type is null) + count(*) filter (where latitude is null)
       + count(*) filter (where longitude is null) as missing_cells
from ({_CLEAN_SQL}) c""",
)
def g8_dataset_statistics(spark, sf_dir):
    return r6(G.dataset_statistics(cleaned(fixtures(spark, sf_dir))))
