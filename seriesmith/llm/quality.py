"""Quality rules with host-level verdicts.

Per document: word, symbol, repeated-line and repeated-window counts of the whole text, in one vectorised pass.
Per host: the rate of documents that fail the base rules, shrunk towards all hosts by a beta prior whose two
parameters are fitted to the hosts' rates by moments. Documents of a host whose shrunk rate exceeds
``max_host_rate`` are rejected as well.

Defined cases: null or empty text has no words and fails the base rules; a null host is a host of its own;
repeated rows count and return as often as they occur; an empty table gives an empty table. Columns other than
the three named are not read, so they can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut
from . import scan

WINDOW = 8
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_rows(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of one run of texts."""
    n = len(offs) - 1
    w = scan.words(data, offs, scan.PLAIN)
    summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offs])
    points = scan.PLAIN[data] & ((data & 0xC0) != 0x80)
    # lines with a word: each is a run between line feeds
    first, last = scan.spans(data != 10, offs)
    full = np.searchsorted(w.starts, first) < np.searchsorted(w.starts, last)
    first, last = first[full], last[full]
    row = np.searchsorted(offs, first, "right") - 1
    keys = scan.in_row(scan.span_hash(scan.prefix(data), first, last), row)
    _, once = np.unique(keys, return_index=True)
    dup = np.bincount(row, minlength=n) - np.bincount(row[once], minlength=n)
    h, at = scan.windows(w.hash, w.bounds, WINDOW)
    _, back, times = np.unique(scan.in_row(h, w.doc[at]), return_inverse=True, return_counts=True)
    again = at[times[back] > 1]
    cover = np.zeros(len(w.hash) + WINDOW + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    covered = np.cumsum(cover)[: len(w.hash)] > 0
    return {"n_words": np.diff(w.bounds), "word_chars": summed(points), "n_symbols": summed(SYMBOLS[data]),
            "n_dup_lines": dup, "n_repeat_words": np.bincount(w.doc[covered], minlength=n)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in scan.pieces(batch.column(2)):
            got = count_rows(data, offs)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[pa.array(got[c], pa.int64()) for c in COUNTS]], ["id", "host", *COUNTS])
    scan.tidy()


def text_counts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, host and the five counts of each document."""
    src = docs.select(docs[id_col].alias("id"), docs[host_col].alias("host"), docs[text_col].alias("text"))
    kinds = dict(src.dtypes)
    return src.mapInArrow(_count, f"id {kinds['id']}, host {kinds['host']}, " + ", ".join(f"{c} long" for c in COUNTS))


def host_rates(counted: DataFrame) -> DataFrame:
    """Per host: documents, failures and the shrunk failure rate. ``counted`` has host and base_failed."""
    hosts = counted.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("var"))
    # one row of prior parameters meets the hosts: read as scalars, no join
    p = prior.first()
    mean, var = (p["mean"] or 0.0, p["var"]) if p["mean"] is not None else (0.0, 0.0)
    spread = mean * (1 - mean)
    # no spread between hosts: every host gets the common rate with a prior as heavy as 1e6 documents
    weight = min(max(spread / var - 1, 0.0), 1e6) if var > 0 else 1e6
    return hosts.withColumn("host_rate", (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
          min_words: int = 20, max_repeat_pct: int = 30, max_host_rate: float = 0.5) -> DataFrame:
    """One row per document: id, host, counts, base_failed, host_rate, kept."""
    base = cut(text_counts(docs, id_col, host_col, text_col).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))))
    hosts = host_rates(base).select(F.col("host").alias("_h"), "host_rate")
    out = base.join(hosts, base["host"].eqNullSafe(hosts["_h"]), "left").drop("_h")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_host_rate))
