"""Chained questions of blocks of documents to hash buckets, over one shuffle of the texts.

As in ``blocks``, a block asks each bucket about its distinct keys, and a bucket answers with the number of all
askers' items and the smallest value given with a key. Here several rounds follow one another: what a block has to
remember from one round to the next travels as a memo through a bucket and back, so that every round reads only the
block's documents (the same, reused exchange) and the last round's answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import scan
from .blocks import cuts, squeeze, unsqueeze
from .common import shuffle_partitions


@dataclass
class Question:
    """Sorted distinct keys of so many bits, the block's number of each, the smallest value of each, and a memo."""

    keys: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    bits: int
    memo: bytes = b""


@dataclass
class Answer:
    """Numbers and smallest values over all blocks, aligned with the question's keys, and the memo."""

    counts: np.ndarray
    least: np.ndarray
    memo: bytes


ASKED = "bucket int, blk int, memo binary, keys binary, counts binary, least binary"
ANSWERED = "blk int, bucket int, memo binary, counts binary, least binary"
ASKED_PA = pa.schema([("bucket", pa.int32()), ("blk", pa.int32()), *[(c, pa.binary()) for c in ("memo", "keys", "counts", "least")]])
ANSWERED_PA = pa.schema([("blk", pa.int32()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("memo", "counts", "least")]])


def _rows(t: pa.Table, q: Question, buckets: int) -> pa.Table:
    blk = t.column("blk")[0].as_py()
    at = cuts(q.keys, q.bits, buckets)
    rows = [(blk % buckets, blk, q.memo, None, None, None)]
    for i in np.flatnonzero(np.diff(at)).tolist():
        p = slice(at[i], at[i + 1])
        rows.append((i, blk, None, scan.pack_sorted(q.keys[p]), squeeze(q.counts[p]), squeeze(q.least[p])))
    return pa.table(dict(zip(ASKED_PA.names, zip(*rows, strict=True), strict=True)), ASKED_PA)


def _answers(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    out = [(r["blk"], -1, r["memo"], None, None) for r in rows if r["memo"] is not None]
    asked = [r for r in rows if r["memo"] is None]
    if asked:
        keys = [scan.unpack_sorted(r["keys"]) for r in asked]
        ends = np.cumsum([len(k) for k in keys])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(back, np.concatenate([unsqueeze(r["counts"]) for r in asked])).astype(np.int64)
        least = np.full(len(counts), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, back, np.concatenate([unsqueeze(r["least"]) for r in asked]).astype(np.uint64))
        for r, k, b in zip(asked, keys, ends, strict=True):
            mine = back[b - len(k) : b]
            out.append((r["blk"], r["bucket"], None, squeeze(counts[mine]), squeeze(least[mine])))
    return pa.table(dict(zip(ANSWERED_PA.names, zip(*out, strict=True), strict=True)), ANSWERED_PA)


def _answer(right: pa.Table) -> Answer:
    rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
    got = [r for r in rows if r["bucket"] >= 0]
    whole = lambda c: np.concatenate([unsqueeze(r[c]) for r in got]) if got else np.zeros(0, np.int64)
    return Answer(whole("counts"), whole("least").astype(np.uint64), next(r["memo"] for r in rows if r["bucket"] < 0))


def _buckets(spark: SparkSession) -> int:
    """Half the shuffle partitions: every block writes to every bucket, and what a bucket holds is small beside a block."""
    return -(-shuffle_partitions(spark) // 2)


def _tidied(out: pa.Table) -> pa.Table:
    scan.tidy()
    return out


def _grouped(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return df.groupBy(key).applyInArrow(lambda t: _tidied(fn(t)), schema)


def _paired(docs: DataFrame, answered: DataFrame, fn: Callable[[pa.Table, Answer], pa.Table], schema: str) -> DataFrame:
    return docs.groupBy("blk").cogroup(answered.groupBy("blk")).applyInArrow(lambda t, a: _tidied(fn(t, _answer(a))), schema)


def ask(docs: DataFrame, first: Callable[[pa.Table], Question]) -> DataFrame:
    buckets = _buckets(docs.sparkSession)
    return _grouped(_grouped(docs, "blk", lambda t: _rows(t, first(t), buckets), ASKED), "bucket", _answers, ANSWERED)


def ask_again(docs: DataFrame, answered: DataFrame, following: Callable[[pa.Table, Answer], Question]) -> DataFrame:
    buckets = _buckets(docs.sparkSession)
    return _grouped(_paired(docs, answered, lambda t, a: _rows(t, following(t, a), buckets), ASKED), "bucket", _answers, ANSWERED)


def finish(docs: DataFrame, answered: DataFrame, last: Callable[[pa.Table, Answer], pa.Table], schema: str) -> DataFrame:
    return _paired(docs, answered, last, schema)
