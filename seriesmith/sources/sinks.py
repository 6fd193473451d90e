"""Partitioned product writers and their readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import scratch_path


def write_table(df: DataFrame, name: str, partitions: Sequence[str] = (), path: str | None = None, mode: str = "overwrite") -> str:
    """Write parquet, replacing only the partitions that are present, and return the path.

    Rows are rebalanced by the partition columns first, so a partition value
    does not leave one small file per task; adaptive execution splits a hot
    value over several tasks again.
    """
    path = path or scratch_path(df.sparkSession, name)
    if partitions:
        df = df.hint("rebalance", *[F.col(p) for p in partitions])
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partitions:
        w = w.partitionBy(*partitions)
    w.parquet(path)
    return path


def write_and_read(df: DataFrame, name: str, partitions: Sequence[str] = ()) -> DataFrame:
    path = write_table(df, name, partitions)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distribution_table(q: DataFrame, stats: DataFrame, keys: Sequence[str], dataset: str, suffix: str, series_key: str) -> DataFrame:
    """Tidy slope distribution with the sizes and variance it came from."""
    st = stats.select(*keys, F.col("n_pairs").alias("n_slopes"), F.col("n").alias("n_samples"), F.col("var").alias("kendall_variance"))
    med = q.where("probability_level = 0.5").select(*keys, F.col("quantile_value_per_year").alias("slope_per_year"))
    return q.join(st, list(keys)).join(med, list(keys)).withColumns(
        {"dataset": F.lit(dataset), "suffix": F.lit(suffix), "series_key": F.lit(series_key)})


def load_distribution(spark: SparkSession, path: str, dataset: str, site: str, suffix: str, season: str | None = None) -> DataFrame:
    """One site's distribution; filters hit the partition columns, so other files are not read."""
    df = spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("site") == site) & (F.col("suffix") == suffix))
    return df.where(F.col("season") == season) if season is not None else df


# Variables kept in a harmonised profile product.
PRODUCT_VARIABLES = ("beta_raw", "beta_smooth", "beta", "fog_flag", "background_noise", "cleaned_negative_profile_flag")
STATE_VARIABLES = ("window_transmission", "laser_pulse_energy", "laser_temperature", "state_detector", "state_laser", "state_optics")
PROFILE_KEYS = ("id", "site", "instrument", "day", "time", "altitude", "range", "height", "range_corrected")


def level1_product(df: DataFrame, source: str, extra_keys: Sequence[str] = ()) -> DataFrame:
    """The fixed product and state variables that exist, with provenance columns."""
    keep = [c for c in (*PROFILE_KEYS, *extra_keys, *PRODUCT_VARIABLES, *STATE_VARIABLES) if c in df.columns]
    return df.select(*keep, F.lit(source).alias("data_source"))


def compact_segments(parts: Sequence[DataFrame], bad_days: DataFrame | None, keys: Sequence[str], time: str = "time", order: str | None = None) -> DataFrame:
    """Daily parts -> one table: first row per key and time, bad days removed, sorted inside range partitions.

    Range partitioning by (keys, time) splits a hot series over many tasks;
    every output file still holds a sorted stretch of time.
    """
    keys = list(keys)
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p, allowMissingColumns=True)
    rest = [c for c in df.columns if c not in (*keys, time)]
    first = F.min_by(F.struct(*rest), F.col(order)) if order else F.any_value(F.struct(*rest))
    df = df.groupBy(*keys, time).agg(first.alias("_r")).select(*keys, time, "_r.*")
    if bad_days is not None:
        b = bad_days.select(*keys, F.col("date").alias("_date")).distinct()
        df = df.withColumn("_date", F.to_date(time)).join(b, [*keys, "_date"], "left_anti").drop("_date")
    return df.repartitionByRange(*keys, time).sortWithinPartitions(*keys, time)
