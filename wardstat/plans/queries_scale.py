"""Registered queries: deduplication by fingerprints, keyed order, publishing at once, the log of a write."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from wardstat.functions import calendar as C
from wardstat.operators import aggregates as A
from wardstat.operators import clean as CL
from wardstat.operators import hotspot as HS
from wardstat.operators import ordering as L
from wardstat.operators.series import numbered
from wardstat.plans import flows
from wardstat.plans.catalog import fixtures, r6, register
from wardstat.plans.queries_core import _LOG_SQL, raw_with_headers
from wardstat.session import scratch_folder, write_table
from wardstat.sources import io as IO


@register("e1_dedup_by_fingerprint", "select distinct * from incidents_raw")
def e1_dedup_by_fingerprint(spark, sf_dir):
    """Only rows that may have a copy are exchanged."""
    return r6(CL.dedup_wide(fixtures(spark, sf_dir).incidents_raw))


@register(
    "e2_new_keys_both_ways",
    """
select 'unlabelled' as side, doc_id as id from (select doc_id from documents where doc_id is not null except select doc_id from labels)
union all select 'never ordered', p_partkey from (select p_partkey from part where p_partkey % 3 = 0 except select l_partkey from lineitem where l_quantity > 40)
union all select 'other part', l_partkey from (select l_partkey from lineitem where l_quantity > 40 except select p_partkey from part where p_partkey % 3 = 0)""",
)
def e2_new_keys_both_ways(spark, sf_dir):
    """E2 where there is a difference, in both directions: documents without a label, and two sets of parts against each other."""
    fx = fixtures(spark, sf_dir)
    some = fx.table("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))  # the set is the query's subject
    large = fx.table("lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id"))
    labels, documents = (fx.table(t).select(F.col("doc_id").alias("id")) for t in ("labels", "documents"))
    parts = (("unlabelled", documents, labels), ("never ordered", some, large), ("other part", large, some))
    out = None
    for side, new, old in parts:
        one = CL.new_values(new, old, "id").select(F.lit(side).alias("side"), "id")
        out = one if out is None else out.unionByName(one)
    return r6(out)


def _permuted_sql(number: str, seed: int = 42, half: int = 20) -> str:
    """CTE-free expression of ``ordering.permuted``, as nested subqueries over ``x(case_no, number)``."""
    size = 1 << half
    sql = f"select case_no, number // {size} as l, number % {size} as r from {number}"
    for k, (times, plus) in enumerate(L._ROUNDS):
        mixed = f"((r * {times} + {plus + seed * (k + 1)}) % {size * 1021})"
        sql = f"select case_no, r as l, (l + (({mixed} // 509 + {mixed} * 31) % {size})) % {size} as r from ({sql}) s{k}"
    return f"select case_no, l * {size} + r as place from ({sql}) done"


@register(
    "l7_keyed_order",
    "with x as (select case_no, row_number() over (order by case_no) as number from incidents_hourly), q as (" + _permuted_sql("x") + """)
select case_no, row_number() over (order by place) as position from q""",
)
def l7_keyed_order(spark, sf_dir):
    """Every row's place in an order that depends on the rows and the seed alone."""
    told = numbered(fixtures(spark, sf_dir).incidents_hourly.select("case_no"), "case_no", name="number")
    return r6(numbered(told, L.permuted(F.col("number")), name="position").select("case_no", "position"))


@register(
    "s8_publish_at_once",
    """select (select count(*) from incidents_hourly) as n_rows, cast(4 as bigint) as versions, cast(4 as bigint) as numbers, true as current_is_last""",
)
def s8_publish_at_once(spark, sf_dir):
    """Four publishers at the same time get four commit numbers, and the highest one's version is current."""
    root = scratch_folder(spark, "s8-at-once")
    h = fixtures(spark, sf_dir).incidents_hourly
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: IO.publish(h.select("case_no", F.lit(k).alias("publisher")), root, f"v{k}"), range(4)))
    log = spark.read.parquet(f"{root}/_versions")
    one = log.agg(F.count("*").alias("versions"), F.count_distinct("commit").alias("numbers"), F.max_by("version", "commit").alias("last"))
    current = IO.read_current(spark, root).agg(F.count("*").alias("n_rows"), F.concat(F.lit("v"), F.max("publisher")).alias("current"))
    return r6(current.join(one, F.col("current") == F.col("last"), "left").select("n_rows", "versions", "numbers", (F.col("current") == F.col("last")).alias("current_is_last")))


@register(
    "g7_log_of_the_write",
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
def g7_log_of_the_write(spark, sf_dir):
    """G7 as a by-product of writing the processed table: the same rows, without a pass of its own."""
    raw = CL.canonical_columns(raw_with_headers(fixtures(spark, sf_dir)))
    return r6(flows.preprocess_logged(raw, scratch_folder(spark, "g7-processed"))[2])


@register(
    "a13_sketched",
    """
select 'case_no' as column_name, count(distinct case_no) as exact, true as within from incidents_monthly
union all select 'district', count(distinct district), true from incidents_monthly
union all select 'crime_type', count(distinct crime_type), true from incidents_monthly""",
)
def a13_sketched(spark, sf_dir):
    """Cardinalities from monthly sketches that were written and are merged, within the stated bound of the exact counts."""
    m = fixtures(spark, sf_dir).incidents_monthly
    columns = ["case_no", "district", "crime_type"]
    merged = A.merged_cardinalities(write_table(A.monthly_sketches(m, columns), "a13-sketches"))
    exact = m.agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot([], columns, "column_name", "exact")
    within = F.abs(F.col("estimate") - F.col("exact")) <= A.SKETCH_BOUND * F.col("exact")
    return r6(merged.join(exact, "column_name").select("column_name", "exact", within.alias("within")))


@register(
    "a28_adaptive_cells",
    """
with f as (select cast(floor((latitude + 90e0) / (360e0 / 65536)) as bigint) as y, cast(floor((longitude + 180e0) / (360e0 / 65536)) as bigint) as x, count(*) as n
           from incidents_hourly where latitude is not null and longitude is not null group by 1, 2),
e as (select level, y >> (16 - level) as y, x >> (16 - level) as x, n from (select *, unnest(range(0, 17)) as level from f)),
c as (select level, y, x, cast(sum(n) as bigint) as crimes from e group by 1, 2, 3)
select c.level, c.y as cell_y, c.x as cell_x, c.crimes, round((c.y + 0.5e0) * (360e0 / pow(2e0, c.level)) - 90e0, 6) as lat,
       round((c.x + 0.5e0) * (360e0 / pow(2e0, c.level)) - 180e0, 6) as lng, round(360e0 / pow(2e0, c.level), 6) as side
from c left join c p on p.level = c.level - 1 and p.y = c.y >> 1 and p.x = c.x >> 1
where (c.crimes <= 100 or c.level = 16) and (c.level = 0 or p.crimes > 100)""",
)
def a28_adaptive_cells(spark, sf_dir):
    """Quadtree cells of at most 100 incidents."""
    return r6(HS.adaptive_cells(fixtures(spark, sf_dir).incidents_hourly, 100))


@register(
    "a28_smoothed_grid",
    """
with g as (select cast(floor(latitude / 0.01e0) as bigint) as cell_y, cast(floor(longitude / 0.01e0) as bigint) as cell_x, count(*) as crimes
           from incidents_hourly where latitude is not null and longitude is not null group by 1, 2),
o as (select dy, dx, exp(-(dy * dy + dx * dx) / 4.5e0) as w from (select unnest(range(-3, 4)) as dy), (select unnest(range(-3, 4)) as dx))
select t.cell_y, t.cell_x, any_value(t.crimes) as crimes, round(any_value((t.cell_y + 0.5e0) * 0.01e0), 6) as lat, round(any_value((t.cell_x + 0.5e0) * 0.01e0), 6) as lng,
       round(sum(s.crimes * w), 6) as density
from g t, o join g s on s.cell_y = t.cell_y - dy and s.cell_x = t.cell_x - dx group by 1, 2""",
)
def a28_smoothed_grid(spark, sf_dir):
    """A Gaussian density over the occupied cells."""
    return r6(HS.smoothed_grid(fixtures(spark, sf_dir).incidents_hourly))


def _dates(spark, sf_dir):
    h = fixtures(spark, sf_dir).incidents_hourly
    texts = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy"}
    return h.select("case_no", *[F.date_format("ts", f).alias(name) for name, f in texts.items()])


@register(
    "r3_format_votes",
    """
with t as (select case_no, day(ts) as d, month(ts) as m from incidents_hourly)
select 'iso' as column_name, count(*) as n_text, count(*) as n_iso, 0 as n_month_first, 0 as n_day_first, 0 as n_ambiguous, 'month first' as chosen from t
union all select 'us', count(*), 0, count(*), count(*) filter (where d <= 12), count(*) filter (where d <= 12 and d <> m), 'month first' from t
union all select 'eu', count(*), 0, count(*) filter (where d <= 12), count(*), count(*) filter (where d <= 12 and d <> m), 'day first' from t""",
)
def r3_format_votes(spark, sf_dir):
    """Which form each column of dates is written in, and how many rows could be read as another day."""
    return r6(C.format_votes(_dates(spark, sf_dir), "iso", "us", "eu"))


@register(
    "r3_parse_by_vote",
    """select case_no, cast(cast(ts as date) as timestamp) as iso, cast(cast(ts as date) as timestamp) as us, cast(cast(ts as date) as timestamp) as eu from incidents_hourly""",
)
def r3_parse_by_vote(spark, sf_dir):
    """Every row of three columns read in its column's form, day-first ones too."""
    t = _dates(spark, sf_dir)
    for c in ("iso", "us", "eu"):
        t = C.parse_by_vote(t, c, c)
    return r6(t)
