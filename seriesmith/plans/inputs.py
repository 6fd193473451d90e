"""How the driver's tables stand in for series, samples, profiles, columns, grids and sites.

Each Spark builder has a matching SQL common table expression, used by the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def R(x: str, n: int = 6) -> str:
    """Rounded SQL expression without negative zero."""
    return f"(round(CAST({x} AS DOUBLE), {n}) + 0e0)"


# Means of cents often sit exactly half-way between two rounded values; both sides move off that grid.
OFF = 3.14159e-5

# --- multi-year irregular samples: five sites, three instruments --------------------------------
def orders_series(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("site"),
        F.col("o_orderstatus").alias("instrument"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("k"),
    )


ORD = """o AS (SELECT o_orderpriority AS site, o_orderstatus AS instrument, CAST(o_orderdate AS DATE) AS date,
 o_totalprice AS value, o_orderkey AS k FROM orders)"""


# --- sub-daily samples ---------------------------------------------------------------------------
def event_samples(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("site"),
        F.concat(F.lit("i"), F.pmod(F.col("user_id"), F.lit(3)).cast("string")).alias("instrument"),
        F.col("ts").cast("timestamp").alias("time"),
        F.col("value"),
        F.col("event_id"),
        F.col("props"),
    )


EV = """e AS (SELECT event_type AS site, 'i' || CAST(user_id % 3 AS VARCHAR) AS instrument, ts AS time,
 CAST(ts AS DATE) AS date, value, event_id, props FROM events)"""


# --- profiles: one row per profile, arrays over 64 gates of 10 m ------------------------------------
def profiles(spark, sf) -> DataFrame:
    b = F.transform("embedding", lambda x: x.cast("double"))
    rng = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: i * F.lit(10.0))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("s"), F.pmod("label", F.lit(4)).cast("string")).alias("site"),
        F.lit("i0").alias("instrument"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("label")).alias("day"),
        F.expr("timestamp_seconds(unix_seconds(timestamp'2020-01-01') + label * 86400 + vec_id * 15)").alias("time"),
        F.lit(5.0).alias("altitude"),
        rng.alias("range"),
        F.transform(rng, lambda r: r + 5.0).alias("height"),
        b.alias("beta_raw"),
        F.lit(True).alias("range_corrected"),
        F.pmod("vec_id", F.lit(7)).eqNullSafe(0).alias("fog_flag"),
    )


PF = """p0 AS (SELECT vec_id AS id, 's' || CAST(label % 4 AS VARCHAR) AS site, label, DATE '2020-01-01' + CAST(label AS INTEGER) AS day,
 list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b, len(embedding) AS n, (vec_id % 7 = 0) AS fog_flag FROM embeddings),
p AS (SELECT *, list_transform(range(1, n + 1), lambda i: CAST(10 * i AS DOUBLE)) AS r FROM p0),
g AS (SELECT id, site, label, day, n, fog_flag, i, b[i] AS b, r[i] AS r, r[i] + 5 AS h FROM p, LATERAL (SELECT unnest(range(1, n + 1)) AS i))"""


# --- sites ------------------------------------------------------------------------------------------
def sites(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("site"),
        F.concat(F.lit("Site "), F.col("s_suppkey").cast("string")).alias("name"),
        F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("country"),
        (F.pmod(F.col("s_suppkey") * 37, F.lit(160)) - 80 + 0.25).alias("lat"),
        (F.pmod(F.col("s_suppkey") * 73, F.lit(360)) - 180 + 0.25).alias("lon"),
    )


SITES = """st AS (SELECT s_name AS site, 'Site ' || CAST(s_suppkey AS VARCHAR) AS name, 'C' || CAST(s_nationkey AS VARCHAR) AS country,
 CAST((s_suppkey * 37) % 160 - 80 AS DOUBLE) + 0.25e0 AS lat, CAST((s_suppkey * 73) % 360 - 180 AS DOUBLE) + 0.25e0 AS lon FROM supplier)"""


# --- file listings: one path per order -----------------------------------------------------------------
def listing(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    ymd = F.when(F.pmod("o_orderkey", F.lit(97)) == 0, F.lit("20011399")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    site = F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1))
    return o.select(
        F.concat(
            F.lit("/lvl0/"), site, F.lit("/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/"),
            F.col("o_orderstatus"), F.lit("_"), ymd, F.lit("_"), F.pmod("o_orderkey", F.lit(3)).cast("string"), F.lit(".nc"),
        ).alias("path"),
        F.col("o_custkey").alias("length"),
        F.col("o_orderkey").alias("k"),
    )


LIST = """fl AS (SELECT '/lvl0/s' || substr(o_orderpriority, 1, 1) || '/' || strftime(o_orderdate, '%Y/%m/%d') || '/' || o_orderstatus || '_' ||
 CASE WHEN o_orderkey % 97 = 0 THEN '20011399' ELSE strftime(o_orderdate, '%Y%m%d') END || '_' || CAST(o_orderkey % 3 AS VARCHAR) || '.nc' AS path,
 o_custkey AS length, o_orderkey AS k FROM orders)"""


# --- grid cells in long form --------------------------------------------------------------------------
def grid(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.to_date("l_shipdate").alias("day"),
        (F.pmod(F.col("l_orderkey"), F.lit(24)) + 1).cast("int").alias("hour_index"),
        (F.pmod(F.col("l_partkey"), F.lit(180)) - 90 + 0.5).alias("lat"),
        (F.pmod(F.col("l_suppkey"), F.lit(360)) + 0.5).alias("lon"),
        F.col("l_linenumber").alias("layer"),
        F.when(F.col("l_quantity") == 50, F.lit(-999.0)).otherwise(F.col("l_discount") * 1000).alias("obs_cld_amount"),
        F.when(F.col("l_quantity") == 49, F.lit(-999.0)).otherwise(F.col("l_tax") * 1000).alias("adj_cld_amount"),
        F.col("l_quantity").alias("aux_qc"),
        F.col("l_orderkey").alias("k"),
    )


GRID = """gr AS (SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_orderkey % 24 + 1 AS INTEGER) AS hour_index,
 CAST(l_partkey % 180 - 90 AS DOUBLE) + 0.5e0 AS lat, CAST(l_suppkey % 360 AS DOUBLE) + 0.5e0 AS lon, l_linenumber AS layer,
 CASE WHEN l_quantity = 50 THEN -999e0 ELSE l_discount * 1000 END AS obs_cld_amount,
 CASE WHEN l_quantity = 49 THEN -999e0 ELSE l_tax * 1000 END AS adj_cld_amount, l_quantity AS aux_qc, l_orderkey AS k FROM lineitem)"""
