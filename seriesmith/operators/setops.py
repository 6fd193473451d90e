"""Set operations, guards and global orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core import cut


def union_series(*frames: DataFrame) -> DataFrame:
    """Concatenation of series with whatever columns each has."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_index(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def missing(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct wanted keys without a match."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass the rows through; a repeated key fails the job and names itself."""
    rest = [c for c in df.columns if c not in keys]
    key_text = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    err = F.raise_error(F.concat(F.lit("duplicated key: "), key_text)).cast("bigint")
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_r"))
    return g.where(F.when(F.col("_n") > 1, err).otherwise(F.col("_n")) == 1).select(*keys, "_r.*")


def series_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row number within each series without putting a series in one task.

    Rows are range-partitioned by (keys, order) and written once, so the stretch
    of each task is fixed; the positions are the offset of the stretch plus the
    place inside it.
    """
    keys = list(keys)
    d = cut(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    sizes = d.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    off = sizes.withColumn("_off", before).drop("_n")
    inside = F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*order))
    return d.withColumn("_i", inside).join(off, [*keys, "_p"]).withColumn("pos", F.col("_off") + F.col("_i")).drop("_p", "_i", "_off")


def rank_line(df: DataFrame, keys: Sequence[str], label: str, metric: str, descending: bool = True) -> DataFrame:
    """Labels of a group in the order of a metric, as one text (a group is a short list such as seasons)."""
    m = -F.col(metric) if descending else F.col(metric)
    lst = F.array_sort(F.collect_list(F.struct(m.alias("m"), F.col(label).alias("l"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(lst, lambda s: s["l"]), " > ").alias("ranking"))
