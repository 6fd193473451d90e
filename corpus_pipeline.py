"""From raw to training-ready documents: each stage applies one of the numbered operators to all that the last one kept.

Every stage's result is written as Parquet in the shared folder and read again as the next one's documents. All stages
but the last return the columns of ``documents``. Rows are told apart by id and text, so rows that repeat an id with
another text are judged on their own, and a null id is an id like any other.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmith.core import scratch_path
from seriesmith.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from seriesmith.llm.common import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_LEFT = 0.5
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of id and text."""
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")).alias("row_key"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose key is not in ``rejected`` (key columns i and h)."""
    gone = rejected.distinct()
    same = docs["row_key"]["h"].eqNullSafe(gone["h"]) & docs["row_key"]["i"].eqNullSafe(gone["i"])
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or stand on a rejected host, go."""
    docs = _keyed(docs)
    return _without(docs, quality.judge(docs, id_col="row_key").filter("not kept").select("id.i", "id.h"))


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; documents of which nothing is left go with them. A document that would lose more
    than half of its text, but not all, stays whole: it may be a near copy, which the next stage judges by its whole text."""
    found = line_dedup.dedup_lines(docs, keep_cols=("lang", "source"), min_left=MIN_LEFT)
    stay = found.filter((F.col("n_removed") == 0) | line_dedup.written(F.col("text")))
    return stay.select(F.col("id").alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest key stays: smallest id, null ids last, equal ids by a hash of
    the text. Rows that repeat id and text become one."""
    docs = _keyed(docs)
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("row_key.i").alias("i"), F.col("row_key.h").alias("h"))
    found = ngram_join.near_duplicates(docs.select(key.alias("near_key"), "text"), id_col="near_key")
    stay = _without(docs, found.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select("id.i", "id.h"))
    return stay.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).select(*COLUMNS)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    docs = _keyed(docs)
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), id_col="row_key")
    return _without(docs, judged.filter("contaminated").select("id.i", "id.h"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit), and whether they decode to the text."""
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    key = F.struct("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).alias("key")
    out = bpe.decode(bpe.encode(docs.select(key, "text"), ranks, id_col="key"), ranks)
    return out.select("id.doc_id", "id.lang", "id.source", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("id.digest")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_copies),
    ("byte-level BPE", tokens),
]

#: Links and tokens can't be written as SQL; the tests compare the stages with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
