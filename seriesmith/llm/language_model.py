"""Stupid-backoff scores from corpus-wide n-gram counts.

Counts of all orders are kept in tables partitioned by hash. A block of documents asks for each of its distinct
n-grams once (so a frequent n-gram costs one entry per block), gets the corpus counts back and sums the scores of its
documents' exploded n-grams. Whole texts, all documents, no cut-off.

Score of a word w after a context: count(context, w) / count(context) at the longest order whose count is not 0, times
``alpha`` for every order backed off; the unigram is count(w) / number of words. With ``exclude_own`` a document's own
n-grams are left out of the counts, so that a text is judged by the other texts; a word that no other text has
counts as ``alpha`` occurrences. The first words of a text have shorter contexts.

Defined cases: null, empty or word-less text has 0 words, score 0 and a null mean; words are lower-cased (A-Z);
repeated rows are separate texts (each one is in the other's counts); extra columns are not read. N-grams are told
apart by 56-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, scan

ORDER = 3
BITS = 56


def grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row of each word, place in the row, and for each order the key of the n-gram that ends at the word (0: none)."""
    w = scan.words(scan.LOWER[data], offs, scan.PLAIN)
    place = np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))
    keys = []
    for k in range(1, order + 1):
        out = np.zeros(len(w.hash), np.uint64)
        h, at = scan.windows(w.hash, w.bounds, k)
        out[at + k - 1] = np.maximum(h >> np.uint64(64 - BITS), np.uint64(1))
        keys.append(out)
    return w.doc, place, keys


def others(keys: np.ndarray, doc: np.ndarray, answers: np.ndarray, exclude_own: bool) -> np.ndarray:
    """Count of the n-gram at each place (0 where there is none), without the row's own occurrences if asked.

    ``answers`` are the counts of the distinct keys in rising order. One stable sort serves both: rows rise with the
    places, so the occurrences of one row stand together within a key.
    """
    at = np.flatnonzero(keys)
    at = at[np.argsort(keys[at], kind="stable")]
    if not at.size:
        return np.zeros(len(keys), np.int64)
    k = keys[at]
    new = np.ones(len(at), bool)
    new[1:] = k[1:] != k[:-1]
    got = answers[np.cumsum(new) - 1]
    if exclude_own:
        d = doc[at]
        new[1:] |= d[1:] != d[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        got = got - np.repeat(size, size)
    out = np.zeros(len(keys), np.int64)
    out[at] = got
    return out


def row_scores(doc: np.ndarray, place: np.ndarray, counts: list[np.ndarray], total: np.ndarray, rows: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Summed natural logarithms of the scores, and words that were backed off, for each row.

    ``counts`` are by order; the context of an n-gram is the one of the order below at the word before.
    """
    order, n = len(counts), len(doc)
    logs = np.full(n, np.nan)
    backed = np.zeros(n, bool)
    steps = np.zeros(n, np.int64)
    for k in range(order, 1, -1):
        can = (place >= k - 1) & np.isnan(logs)
        seen = counts[k - 1]
        before = np.zeros(n, np.int64)
        before[1:] = counts[k - 2][:-1]
        hit = can & (seen > 0)
        logs[hit] = np.log(seen[hit] / before[hit]) + steps[hit] * np.log(alpha)
        miss = can & ~hit
        steps[miss] += 1
        backed |= miss
    left = np.isnan(logs)
    seen = counts[0][left]
    logs[left] = np.where(seen > 0, np.log(np.maximum(seen, 1)), np.log(alpha)) - np.log(np.maximum(total[doc[left]], 1)) + steps[left] * np.log(alpha)
    return np.bincount(doc, logs, minlength=rows)[:rows], np.bincount(doc, backed, minlength=rows)[:rows].astype(np.int64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = 0.4, exclude_own: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_backed_off, log_score, mean_log_score. The corpus is ``docs`` itself."""
    src = blocks.blocked(docs, id_col, text_col)
    kind = dict(src.dtypes)["id"]

    def block(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        parts = [(a, grams(data, offs, order)) for a, _, data, offs in scan.pieces(t.column("text"))]
        doc = np.concatenate([np.zeros(0, np.int64), *[a + g[0] for a, g in parts]])
        place = np.concatenate([np.zeros(0, np.int64), *[g[1] for _, g in parts]])
        return doc, place, [np.concatenate([np.zeros(0, np.uint64), *[g[2][i] for _, g in parts]]) for i in range(order)]

    def ask(t: pa.Table) -> list[blocks.Items]:
        return [blocks.Items(*np.unique(k[k > 0], return_counts=True), BITS) for k in block(t)[2]]

    def use(t: pa.Table, answers: list, totals: list) -> pa.Table:
        rows = t.num_rows
        doc, place, keys = block(t)
        n = np.bincount(doc, minlength=rows)
        counts = []
        for i in range(order):
            counts.append(others(keys[i], doc, answers[i], exclude_own))
            keys[i] = None
        got, backed = row_scores(doc, place, counts, totals[0] - (n if exclude_own else np.zeros(rows, np.int64)), rows, alpha)
        return pa.table([t.column("id"), pa.array(n, pa.int64()), pa.array(backed, pa.int64()), pa.array(got)], ["id", "n_words", "n_backed_off", "log_score"])

    scored = blocks.exchange(src, ask, use, f"id {kind}, n_words long, n_backed_off long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
