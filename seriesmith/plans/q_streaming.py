"""Streaming jobs run to the end of the available files."""

from pyspark.sql import functions as F

from ..core import r6, scratch_path
from ..streaming import stream as st
from .inputs import EV, LIST, R, with_
from .registry import query


def _file_stream(spark, sf, name):
    """One of the tables as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("st_daily_cover", with_(EV, "mx AS (SELECT max(time) AS m FROM e)") + f"""SELECT site, date, {R('avg(value)')} AS value, CAST(count(value) AS BIGINT) AS n_samples FROM e, mx
 WHERE CAST(date AS TIMESTAMP) + INTERVAL 1 DAY <= m - INTERVAL 1 DAY GROUP BY site, date HAVING count(value) >= 50""")
def st_daily_cover(spark, sf):
    e = _file_stream(spark, sf, "events").select(
        F.col("event_type").alias("site"), F.col("ts").cast("timestamp").alias("time"), "value", "event_id")
    out = scratch_path(spark, "daily-cover")
    st.append_to(st.daily_cover(e, ["site"], min_samples=50), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    d = spark.read.schema("site string, date date, value double, n_samples bigint").parquet(f"{out}/data")
    return d.select("site", "date", r6("value").alias("value"), "n_samples")


@query("st_incremental_ingest", with_(LIST) + "SELECT path, arg_max(length, k) AS length, max(k) AS modified FROM fl GROUP BY path")
def st_incremental_ingest(spark, sf):
    o = _file_stream(spark, sf, "orders")
    ymd = F.when(F.pmod("o_orderkey", F.lit(97)) == 0, F.lit("20011399")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    path = F.concat(F.lit("/lvl0/s"), F.substring("o_orderpriority", 1, 1), F.lit("/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/"),
                    F.col("o_orderstatus"), F.lit("_"), ymd, F.lit("_"), F.pmod("o_orderkey", F.lit(3)).cast("string"), F.lit(".nc"))
    src = o.select(path.alias("path"), F.col("o_custkey").alias("length"), F.col("o_orderkey").alias("modified"))
    root = scratch_path(spark, "ingest")
    st.incremental_ingest(spark, src, root).awaitTermination()
    return st.read_catalog(spark, root).select("path", "length", "modified")
