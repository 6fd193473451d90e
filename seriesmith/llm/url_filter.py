"""URL filter: rules of host and path, and gradient-boosted trees on lexical features where no rule decides.

A rule fits its host and all subdomains where the URL's path starts with the rule's; the longest rule wins. The URLs that
rules decide are the labelled ones (or a caller's own): trees are boosted on lengths, depth, digit ratio, character
entropy, parameter counts and statistics of the host's suffixes, and judge the rest. Everything is built from DataFrame
functions and Spark's own gradient boosting; no Python runs on the executors.

Trees are fitted on at most about ``max_rows`` distinct labelled URLs (20,000), a sample by hash of the URL. Suffix
statistics count all distinct labelled URLs: of the last one and the last two labels of the host, the blocked share, shrunk
to the share of all. Only suffixes of at least 1/1000 of the labelled URLs have their own, so each list has 1,000 entries
at most and is broadcast; the others count as the share of all.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no rule; it is judged by its features
like any other (a null like an empty text). Repeated URLs get the same verdict. Labelled URLs of one kind only give that
verdict, none at all ``allow``. Very long URLs are measured whole. An empty table gives an empty table; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed rules of the contract: verdict, host and the beginning of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_ROWS = 20_000
SUPPORT = 1000
#: Weight, in URLs, of the share of all in a suffix's blocked share.
PRIOR = 20.0
LEXICAL = ("n_url", "n_host", "n_path", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "entropy", "n_params", "n_query", "n_hyphens",
           "n_percent", "n_extension", "last_segment", "has_fragment", "is_secure")
SUFFIXES = ("suffix1", "suffix2")
FEATURES = (*LEXICAL, "rate1", "rate2", "share1", "share2")


def lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, and then up to ``?``, ``#`` or the end."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct of rule (host and path as one string) and verdict of the longest rule that fits; null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    n = F.length(c)
    kinds = F.array_distinct(F.split(c, ""))
    share = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(kinds, F.lit(0.0), lambda s, x: s - F.when(x == "", 0.0).otherwise(share(x) * F.log2(share(x))))).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the lexical features and the host's suffixes to rows with url (not null), host and path."""
    u, host, path = F.col("url"), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    segment = F.regexp_extract(path, r"([^/]*)/?$", 1)
    labels = F.when(host == "", F.array().cast("array<string>")).otherwise(F.split(host, r"\."))
    feats = {
        "n_url": F.length(u), "n_host": F.length(host), "n_path": F.length(path), "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "host_labels": F.size(labels), "digit_ratio": _ratio(_count(u, "[0-9]"), F.length(u)), "host_digit_ratio": _ratio(_count(host, "[0-9]"), F.length(host)),
        "entropy": entropy(u), "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "n_query": F.length(query),
        "n_hyphens": _count(u, "[-_]"), "n_percent": _count(u, "%"), "n_extension": F.length(F.regexp_extract(segment, r"\.([A-Za-z0-9]+)$", 1)),
        "last_segment": F.length(segment), "has_fragment": F.instr(u, "#") > 0, "is_secure": u.startswith("https://"),
    }
    last = lambda k: F.array_join(F.slice(labels, -F.least(F.lit(k), F.size(labels)), k), ".")
    tail = lambda k: F.when(host == "", "").otherwise(last(k))
    return rows.withColumns({**{k: c.cast("double") for k, c in feats.items()}, "suffix1": tail(1), "suffix2": tail(2)})


def suffix_statistics(labelled: DataFrame, n: int, blocked: int) -> list[DataFrame]:
    """For each kind of suffix: the suffix, its shrunk blocked share and its share of the labelled URLs."""
    out = []
    for k, name in enumerate(SUFFIXES, 1):
        counts = labelled.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("b")).filter(F.col("n") * SUPPORT >= n)
        out.append(stored(counts.select(name, ((F.col("b") + PRIOR * blocked / n) / (F.col("n") + PRIOR)).alias(f"rate{k}"), (F.col("n") / n).alias(f"share{k}")), name))
    return out


@dataclass
class Model:
    """Verdict of one kind only (``trees`` is None), or trees with the suffix statistics that they read."""

    only: str
    trees: GBTClassificationModel | None = None
    suffixes: Sequence[DataFrame] = ()
    share: float = 0.0
    n_labelled: int = 0


def features(rows: DataFrame, suffixes: Sequence[DataFrame], share: float) -> DataFrame:
    out = lexical(rows)
    for k, (name, stats) in enumerate(zip(SUFFIXES, suffixes, strict=True), 1):
        out = out.join(F.broadcast(stats), name, "left").fillna({f"rate{k}": share, f"share{k}": 0.0})  # at most SUPPORT rows
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(out)


def train(labelled: DataFrame, max_rows: int = MAX_ROWS, trees: int = 20, depth: int = 4, seed: int = 1) -> Model:
    """Trees from labelled URLs: columns url and verdict (allow or block). A URL with both counts as blocked."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(F.coalesce("url", F.lit("")).alias("url"), (F.col("verdict") == "block").cast("double").alias("label"))
    rows = rows.groupBy("url").agg(F.max("label").alias("label"))  # copies of a URL are one example
    rows = stored(lexical(rows.withColumns({"host": host, "path": path})).drop("host", "path"), "labelled")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("b")).first()
    n, blocked = total["n"], total["b"] or 0.0
    if blocked in (0, n):
        return Model("block" if n and blocked else "allow", n_labelled=n)
    stats = suffix_statistics(rows, n, blocked)
    part = min(1.0, max_rows / n)
    sample = rows.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else rows
    sample = sample.select("url", "label").withColumns({"host": host, "path": path})
    # written once, few rows of some numbers: the boosting rounds read them again and again
    fit = stored(features(sample, stats, blocked / n).select("features", "label").coalesce(8), "boosting")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=5)
    return Model("", gbt.fit(fit), stats, blocked / n, n)


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """Adds p_block, the modelled probability, to rows with url, host and path."""
    if model.trees is None:
        return rows.withColumn("p_block", F.lit(1.0 if model.only == "block" else 0.0))
    scored = model.trees.transform(features(rows.withColumn("url", F.coalesce("url", F.lit(""))), model.suffixes, model.share))
    return scored.withColumn("p_block", vector_to_array("probability")[1])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", threshold: float = 0.5, **training: int) -> DataFrame:
    """id, host, path, rule, verdict and p_block of every row. ``labelled`` (url, verdict) replaces the URLs that rules decide."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = rows.filter("found is not null").select("url", F.col("found.verdict").alias("verdict"))
    out = predict(rows, train(labelled, **training))
    own = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "p_block")
