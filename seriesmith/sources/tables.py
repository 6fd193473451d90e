"""Scans of site tables, gridded files and series groups."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import require_columns

# Cloud layers of the satellite product, gravity, and the model's missing-data fill.
LAYER_LABELS = {1: "high", 2: "mid_high", 3: "mid_low", 4: "low", 5: "total"}
GRAVITY = 9.80665
FILL = -999.0


def read_sites(df: DataFrame, require: Sequence[str] = ()) -> DataFrame:
    """Site table; missing required columns are an error that names them in order."""
    return require_columns(df, ["site", "lat", "lon", *require], "site table")


def site_coordinates(sites: DataFrame, wanted: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """lat/lon of all or the wanted sites; a wanted site without metadata raises (or is skipped)."""
    s = sites.select("site", "lat", "lon")
    if wanted is None:
        return s
    j = wanted.select("site").distinct().join(s.withColumn("_known", F.lit(True)), "site", "left")
    if not strict:
        return j.where("_known").drop("_known")
    err = F.raise_error(F.concat(F.lit("unknown site: "), F.col("site"))).cast("double")
    return j.select("site", *[F.when(F.col("_known"), F.col(c)).otherwise(err).alias(c) for c in ("lat", "lon")])


def fractional_hours(date: Column | str, hours: Column | str) -> Column:
    """Decimal hours since a date as a timestamp, to the microsecond."""
    d = F.col(date) if isinstance(date, str) else date
    h = F.col(hours) if isinstance(hours, str) else hours
    return F.timestamp_micros(F.unix_micros(d.cast("timestamp")) + F.rint(h * 3.6e9).cast("bigint"))


def hour_index_time(date: Column | str, hour: Column | str) -> Column:
    """1-based hour index of a day as the middle of that hour."""
    d = F.col(date) if isinstance(date, str) else date
    h = F.col(hour) if isinstance(hour, str) else hour
    return F.timestamp_micros(F.unix_micros(d.cast("timestamp")) + ((h.cast("bigint") - 1) * 3600 + 1800) * 1000000)


def decode_grid(df: DataFrame, keep: str, keys: Sequence[str], fill: float = FILL, layer: str = "layer",
                labels: dict[int, str] | None = None) -> DataFrame:
    """Columns matching a pattern with fill -> NULL, percent cover -> fraction, harmonised names, layer label."""
    cols = [c for c in df.columns if re.search(keep, c)]
    out = []
    for c in cols:
        v = F.nullif(F.col(c).cast("double"), F.lit(fill))
        name = c.replace("cld", "cloud").replace("amount", "cover")
        out.append((v / 100.0 if name.endswith("cover") else v).alias(name))
    names = labels or LAYER_LABELS
    lab = F.lit("unknown")
    for k, v in names.items():
        lab = F.when(F.col(layer) == k, v).otherwise(lab)
    return df.select(*keys, F.col(layer), lab.alias("layer_name"), *out)


def multi_file(spark: SparkSession, pattern: str, geopotential: str) -> DataFrame:
    """Many files as one table, with the surface altitude from the geopotential."""
    return spark.read.parquet(pattern).withColumn("surface_altitude", F.col(geopotential) / GRAVITY)


def drop_synthetic(df: DataFrame, site: Sequence[str], instrument: str = "instrument", synthetic: str = "super") -> DataFrame:
    """Drop the merged series of a site wherever real instruments exist."""
    real = df.where(F.col(instrument) != synthetic).select(*site).distinct()
    return df.where(F.col(instrument) != synthetic).unionByName(
        df.where(F.col(instrument) == synthetic).join(real, list(site), "left_anti"))


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> DataFrame | None:
    """The first candidate product that exists, through the file system of its path."""
    sc = spark.sparkContext
    for c in candidates:
        p = sc._jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p):
            return spark.read.parquet(c)
    return None
