"""Test-fixture views over the driver tables.

Each view is built twice: with the DataFrame API (what the Spark queries read)
and as SQL text (prefixed as CTEs to every DuckDB oracle). Both give the same
rows; the oracle comparison of every query checks it.
"""

from __future__ import annotations

import weakref
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: severity lookup for the fixture event types ('signup' is absent on purpose)
SEVERITY_ROWS = (("error", "High"), ("purchase", "Medium"), ("click", "Low"), ("view", "Low"))

# fixed values: coarse class of each fixture event type (ours; the original has none)
CLASS_MAP = {"violent": ("error",), "property": ("purchase",), "drug": ("signup",)}


# Resolved driver tables per live session (weak: a stopped, dropped session frees them).
_SESSION_TABLES: "weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()


def refresh_tables(spark: SparkSession) -> None:
    """Forget the resolved tables of ``spark`` (new files are listed on next use)."""
    _SESSION_TABLES.pop(spark, None)


@dataclass
class Fixtures:
    """Lazy fixture views for one scale-factor folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        """The driver table ``name``, resolved once per session (listing and
        footer schema), as a catalog table would be; later calls reuse the
        relation. ``refresh_tables`` forgets them when files change."""
        path = f"{self.sf_dir}/{name}.parquet"
        tables = _SESSION_TABLES.setdefault(self.spark, {})
        if path not in tables:
            tables[path] = self.spark.read.parquet(path)
        return tables[path]

    @cached_property
    def incidents_hourly(self) -> DataFrame:
        """30 days with true hours; 40 uneven zones as districts."""
        ev = self.table("events").select("event_id", "ts", "event_type")
        zone = F.floor(F.sqrt(F.col("event_id") % 1600)).cast("int")
        z = ev.withColumn("zone", zone)
        zone_s, eid = F.col("zone"), F.col("event_id")
        return z.select(
            eid.alias("case_no"),
            F.col("ts"),
            F.concat(F.lit("Zone "), zone_s.cast("string")).alias("district"),
            F.concat(F.lit("State "), (zone_s % 5).cast("string")).alias("state"),
            F.col("event_type").alias("crime_type"),
            (F.lit(28.6) + ((zone_s * 37) % 100 - 50) / 200.0 + ((eid * 13) % 100 - 50) / 5000.0).alias("latitude"),
            (F.lit(77.2) + ((zone_s * 53) % 100 - 50) / 200.0 + ((eid * 29) % 100 - 50) / 5000.0).alias("longitude"),
        )

    @cached_property
    def incidents_monthly(self) -> DataFrame:
        """Orders as incidents: 25 nations as districts, regions as states."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_name", "n_regionkey")
        region = self.table("region").select("r_regionkey", "r_name")
        # No broadcast hints: the planner broadcasts a side only when its size
        # estimate (file statistics) is under spark.sql.autoBroadcastJoinThreshold,
        # and AQE re-checks measured sizes at run time. nation and region pass that
        # check at every scale; customer grows with the data and gets a sort-merge
        # join at scale.
        # orders-customer first: without column statistics a join's size estimate is
        # the product of its inputs, so joining customer to nation/region first would
        # make the customer side look larger than the orders side.
        geo = nation.join(region, nation.n_regionkey == region.r_regionkey, "inner")
        j = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
        j = j.join(geo, j.c_nationkey == geo.n_nationkey, "inner")
        return j.select(
            F.col("o_orderkey").alias("case_no"),
            F.col("o_orderdate").alias("ts"),
            F.col("n_name").alias("district"),
            F.col("r_name").alias("state"),
            F.col("o_orderpriority").alias("crime_type"),
        )

    @cached_property
    def incidents_raw(self) -> DataFrame:
        """Messy text version of the hourly view, with 10% full duplicates."""
        h = self.incidents_hourly
        d = h.unionByName(h.where(F.col("case_no") % 10 == 0))
        c = F.col("case_no")
        date_text = F.when(c % 50 == 0, F.lit("not a date")).otherwise(F.col("ts").cast("date").cast("string"))
        district_text = (
            F.when(c % 4 == 0, F.concat(F.lit("  "), F.upper("district")))
            .when(c % 4 == 1, F.concat(F.lower("district"), F.lit(" ")))
            .when(c % 4 == 2, F.replace(F.lower("district"), F.lit(" "), F.lit("-")))
        )
        type_text = F.when(c % 7 != 0, F.concat(F.lit(" "), F.upper("crime_type")))
        lat = F.when(c % 9 != 0, F.col("latitude"))
        return d.select(
            c.alias("case_no"),
            date_text.alias("date_text"),
            district_text.alias("district_text"),
            type_text.alias("type_text"),
            lat.alias("latitude"),
            F.col("longitude"),
        )

    @cached_property
    def district_dim(self) -> DataFrame:
        """District dimension: state, centroid, synthetic population.

        Grouped by (district, state) first: both levels then hash-aggregate over the
        incidents (a minimum of text would sort them), and the text minimum runs on
        a few rows per district."""
        per = self.incidents_hourly.groupBy("district", "state").agg(
            F.sum("latitude").alias("_lat"), F.count("latitude").alias("_nlat"),
            F.sum("longitude").alias("_lon"), F.count("longitude").alias("_nlon"),
        )
        return per.groupBy("district").agg(
            F.min("state").alias("state"),
            (F.sum("_lat") / F.sum("_nlat")).alias("lat"),
            (F.sum("_lon") / F.sum("_nlon")).alias("lon"),
            (F.lit(4000) + 500 * F.substring("district", 6, 1 << 20).cast("int")).alias("population"),
        )

    @cached_property
    def severity_dim(self) -> DataFrame:
        return self.spark.createDataFrame(list(SEVERITY_ROWS), "crime_type string, crime_severity string")


# ---------------------------------------------------------------------------
# The same views as SQL text for the DuckDB oracle (also valid Spark SQL).
VIEW_SQL = {
    "incidents_hourly": """
select z.event_id as case_no, z.ts,
       'Zone ' || cast(z.zone as string) as district,
       'State ' || cast(z.zone % 5 as string) as state,
       z.event_type as crime_type,
       28.6e0 + ((z.zone * 37) % 100 - 50) / 200e0 + ((z.event_id * 13) % 100 - 50) / 5000e0 as latitude,
       77.2e0 + ((z.zone * 53) % 100 - 50) / 200e0 + ((z.event_id * 29) % 100 - 50) / 5000e0 as longitude
from (select *, cast(floor(sqrt(event_id % 1600)) as int) as zone from events) z""",
    "incidents_monthly": """
select o_orderkey as case_no, o_orderdate as ts, n_name as district, r_name as state, o_orderpriority as crime_type
from orders
join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey""",
    "incidents_raw": """
select case_no,
       case when case_no % 50 = 0 then 'not a date' else cast(cast(ts as date) as string) end as date_text,
       case case_no % 4 when 0 then '  ' || upper(district) when 1 then lower(district) || ' '
                        when 2 then replace(lower(district), ' ', '-') else null end as district_text,
       case when case_no % 7 = 0 then null else ' ' || upper(crime_type) end as type_text,
       case when case_no % 9 = 0 then null else latitude end as latitude,
       longitude
from (select * from incidents_hourly
      union all
      select * from incidents_hourly where case_no % 10 = 0) d""",
    "district_dim": """
select district, min(state) as state, avg(latitude) as lat, avg(longitude) as lon,
       4000 + 500 * cast(substring(district, 6) as int) as population
from incidents_hourly group by district""",
    "severity_dim": """
select * from (values ('error', 'High'), ('purchase', 'Medium'), ('click', 'Low'), ('view', 'Low')) t(crime_type, crime_severity)""",
}


def with_views(body: str) -> str:
    """Prefix an oracle query with every fixture view as a CTE."""
    ctes = ",\n".join(f"{name} as ({sql.strip()})" for name, sql in VIEW_SQL.items())
    body = body.strip()
    if body[:15].lower() == "with recursive ":
        return f"with recursive {ctes},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
