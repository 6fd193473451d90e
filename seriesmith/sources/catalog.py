"""File catalogues: discovery, parsing of names, choice of one file per day, incremental state.

A catalogue is an ordinary table of paths. "One per day" choices are grouped
aggregates (min_by), which combine on the map side; no window sorts all the
versions of a hot key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import require_rows
from ..operators.setops import series_positions


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below a root; the content column is pruned, so only listings are read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        .select("path", "length", "modificationTime")
    )


def date_from_name(path: Column | str, pattern: str = r"(\d{8})[^/]*$", fmt: str = "yyyyMMdd") -> Column:
    """Date in a file name, NULL when absent or impossible."""
    p = F.col(path) if isinstance(path, str) else path
    return F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")), F.lit(fmt)))


def parse_daily(listing: DataFrame, name_pattern: str = r"/([^/]+)/\d{4}/\d{2}/\d{2}/([^/_]+)_(\d{8})_(\d)\.nc$") -> DataFrame:
    """Site, instrument, date and version from paths; rows whose date does not parse are dropped."""
    return (
        listing.withColumns({
            "site": F.regexp_extract("path", name_pattern, 1), "instrument": F.regexp_extract("path", name_pattern, 2),
            "date": date_from_name(F.regexp_extract("path", name_pattern, 3), r"(\d{8})"),
            "version": F.regexp_extract("path", name_pattern, 4)})
        .where(F.col("date").isNotNull())
    )


def in_order(catalogue: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The catalogue with each row's place in its series; an empty catalogue is an error, as a missing one is for the reader."""
    return series_positions(require_rows(catalogue, "the catalogue"), keys, order)


def expand_sites(files: DataFrame, sites: DataFrame, key: str = "site") -> tuple[DataFrame, DataFrame]:
    """Catalogue rows with the site's name, and the rejected rows with a reason."""
    j = files.join(sites, key, "left")
    reason = (
        F.when(F.col("name").isNull(), "unknown site").when(F.col("instrument") == "", "no instrument").when(F.col("date").isNull(), "no date"))
    j = j.withColumn("reason", reason)
    return j.where(F.col("reason").isNull()).drop("reason"), j.where(F.col("reason").isNotNull())


def directory_dates(listing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct dates named by YYYY/MM/DD directories."""
    p = r"/(\d{4}/\d{2}/\d{2})/"
    d = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract("path", p, 1), F.lit("")), F.lit("yyyy/MM/dd")))
    return listing.withColumn("date", d).where(F.col("date").isNotNull()).select(*keys, "date").distinct()


# Fixed value: the satellite product's file name form.
GRANULE = r"^CER_([^_]+)_([^_]+)_(Edition[^_]+)_(\d+)\.(\d{8})\.hdf$"


def parse_granules(listing: DataFrame, name: str = "file", year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Product, platforms, edition, granule and date of satellite files; names that do not match, or have an impossible date, go to the second frame."""
    day = F.to_date(F.try_to_timestamp(F.regexp_extract(name, GRANULE, 5), F.lit("yyyyMMdd")))
    ok = F.coalesce(F.col(name).rlike(GRANULE) & day.isNotNull(), F.lit(False))
    parsed = listing.where(ok).withColumns({
        c: F.regexp_extract(name, GRANULE, i + 1) for i, c in enumerate(("product", "platforms", "edition", "granule"))
    }).withColumn("time", day)
    if year is not None:
        parsed = parsed.where(F.year("time") == year)
    return parsed, listing.where(~ok)


def prefer(files: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first by the ordering columns (the path breaks ties)."""
    keep = list(keep or [c for c in files.columns if c not in keys])
    best = F.min_by(F.struct(*keep), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("path").alias("op")))
    return files.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def rank_of(value: Column | str, preference: Sequence[str]) -> Column:
    """Position in a preference list; values outside come last."""
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(len(preference))
    for i in range(len(preference) - 1, -1, -1):
        out = F.when(v == preference[i], F.lit(i)).otherwise(out)
    return out


def product_files(listing: DataFrame, prefix: str) -> DataFrame:
    """Files below versioned product directories (``prefix.version``)."""
    d = F.regexp_extract("path", r"^/([^/]+)/", 1)
    return listing.withColumn("product_dir", d).where(F.startswith(F.col("product_dir"), F.lit(prefix))).withColumn(
        "product_version", F.regexp_extract("product_dir", r"\.(.+)$", 1))


def upsert(old: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old (if any) and new catalogue merged by source path; the newest generation wins, then the largest order value."""
    both = new.withColumn("_gen", F.lit(1))
    if old is not None:
        both = old.withColumn("_gen", F.lit(0)).unionByName(both, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_gen")]
    best = F.max_by(F.struct(*rest), F.struct(F.col("_gen"), F.col(order)))
    return both.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def site_signature(sites: DataFrame, key: str = "site") -> DataFrame:
    """One-row frame with the sha256 of the sorted site ids (a site list is bounded by the network)."""
    return sites.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(key)), "\n"), 256).alias("signature"))


def pending(files: DataFrame, done: DataFrame, signature: Column, path: str = "path") -> DataFrame:
    """Files not yet processed for the same site set."""
    d = done.where(F.col("signature") == signature).select(path).distinct()
    return files.join(d, path, "left_anti")


def quality_gate(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Drop rows with a state beyond its limit: ``qc_*`` above, others below; NULL never rejects."""
    bad = F.lit(False)
    for c, lim in limits.items():
        if c in df.columns:
            cond = F.col(c) > lim if c.startswith("qc_") else F.col(c) < lim
            bad = bad | F.coalesce(cond, F.lit(False))
    return df.where(~bad)
