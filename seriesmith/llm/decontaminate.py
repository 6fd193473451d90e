"""Benchmark decontamination with suffix arrays over the training words.

Every run of documents (a shard of some megabytes) gets a suffix array over its words, sorted by packing ranks of
neighbouring words and tripling the depth, only where suffixes are still tied. All test windows are then
binary-searched in every shard at once. No shuffle: the shards are the scan's own partitions, and the test set is
sent to the tasks in blocks of at most ``block_bytes`` of text. Where a window occurs, the match is carried on word by word
to the longest verbatim match with any test suffix, found in a suffix array over the block's items.

Defined cases: null or empty text has no words and is clean; an item without words has no window; an item shorter
than the window is one window; equal windows of several items count for each item; repeated document rows are
judged each; no items means nothing is hit; texts of any length are searched whole; of equally long matches the first
place counts, and documents without a hit have no longest match (0 words, NULL place). Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut
from . import scan

WINDOW = 13


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``seq`` (small non-negative integers) by their first ``depth`` values at least."""
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length()) if n else 1
    per = max(1, min(63 // bits, depth))
    key = np.zeros(n, np.int64)
    for j in range(per):
        key <<= bits
        key[: n - j] |= seq[j:]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    start = np.ones(n, bool)
    start[1:] = ordered[1:] != ordered[:-1]
    slot = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = slot + 1  # 0: past the end
    done, bits = per, max(1, n.bit_length())
    while done < depth:
        tied = np.ones(n, bool)
        tied[:-1] = slot[:-1] == slot[1:]
        tied[-1:] = False
        tied[1:] |= slot[1:] == slot[:-1]
        at = np.flatnonzero(tied)
        if not at.size:
            break
        pos = sa[at]
        more = 2 if 3 * bits <= 63 else 1
        key = rank[pos]
        for j in range(1, more + 1):
            key = (key << bits) | rank[np.minimum(pos + j * done, n)]
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[at] = pos
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        slot[at] = np.maximum.accumulate(np.where(new, at, 0))
        rank[pos] = slot[at] + 1
        done *= more + 1
    return sa


def search(seq: np.ndarray, sa: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end place in ``sa`` of the suffixes that begin with each row of ``queries``."""
    q, k = queries.shape
    padded = np.concatenate([seq, np.full(k, -1, seq.dtype)])
    cols = np.arange(k)

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(q, np.int64), np.full(q, len(sa), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            got = padded[sa[mid][:, None] + cols]
            differ = got != queries[open_]
            first = differ.argmax(1)
            rows = np.arange(len(open_))
            less = np.where(differ[rows, first], got[rows, first] < queries[open_][rows, first], upper)
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    return bound(False), bound(True)


class TestSet:
    """The windows of the test items: distinct word-hash rows by length, and the items of each."""

    __test__ = False

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        data, offs = scan.utf8(pa.array(texts, pa.string()))
        w = scan.words(scan.LOWER[data], offs, scan.ALNUM)
        self.window, self.ids = window, ids
        rows: dict[bytes, set[int]] = {}
        for i in range(len(ids)):
            h = w.hash[w.bounds[i] : w.bounds[i + 1]]
            size = min(window, len(h))
            for j in range(len(h) - size + 1 if size else 0):
                rows.setdefault(h[j : j + size].tobytes(), set()).add(i)
        self.items = [(w.hash[w.bounds[i] : w.bounds[i + 1]]) for i in range(len(ids))]
        by: dict[int, list[bytes]] = {}
        for key in rows:
            by.setdefault(len(key) // 8, []).append(key)
        self.by_length = [(size, np.frombuffer(b"".join(keys), np.uint64).reshape(-1, size), [sorted(rows[k]) for k in keys]) for size, keys in sorted(by.items())]
        self.depth = max((size for size, *_ in self.by_length), default=1)
        # the items one after another, a 0 ending each, and the order of their suffixes
        self.vocabulary, numbers = np.unique(w.hash, return_inverse=True)
        self.seq = np.zeros(len(numbers) + len(ids), np.int64)
        self.seq[np.arange(len(numbers)) + np.repeat(np.arange(len(ids)), np.diff(w.bounds))] = numbers + 1
        self.sa = suffix_array(self.seq, max(map(len, self.items), default=1))


class Shard:
    """Words of a run of documents with their suffix array; a 0 ends each document."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, depth: int):
        self.w = w = scan.words(scan.LOWER[data], offs, scan.ALNUM)
        n = len(offs) - 1
        self.vocabulary, ids = np.unique(w.hash, return_inverse=True)
        self.seq = np.zeros(len(w.hash) + n, np.int64)
        self.doc = np.repeat(np.arange(n), np.diff(w.bounds) + 1)
        self.seq[np.arange(len(ids)) + w.doc] = ids + 1
        self.sa = suffix_array(self.seq, depth)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of the shard, 0 for words that it doesn't have."""
        if not len(self.vocabulary):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


STRETCH = 16


def common_words(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """How many values agree from each place of ``a`` and of ``b`` on; both end in STRETCH values that agree with nothing."""
    n = np.zeros(len(at), np.int64)
    rows = np.arange(len(at))
    steps = np.arange(STRETCH)
    while rows.size:
        differ = a[(at[rows] + n[rows])[:, None] + steps] != b[(bt[rows] + n[rows])[:, None] + steps]
        ended = differ.any(1)
        n[rows] += np.where(ended, differ.argmax(1), STRETCH)
        rows = rows[~ended]
    return n


def longest_at(shard: Shard, tests: TestSet, places: np.ndarray) -> np.ndarray:
    """Words of the longest verbatim match between any test suffix and the text from each place on.

    A binary search among the ordered test suffixes ends between the two that agree longest with the text.
    """
    if not len(places) or not len(tests.sa):
        return np.zeros(len(places), np.int64)
    at = np.minimum(np.searchsorted(tests.vocabulary, shard.vocabulary), max(len(tests.vocabulary) - 1, 0))
    number = np.concatenate([[-1], np.where(tests.vocabulary[at] == shard.vocabulary, at + 1, -1)])  # document ends agree with nothing
    text = np.concatenate([number[shard.seq], np.full(STRETCH, -1, np.int64)])
    items = np.concatenate([tests.seq, np.zeros(STRETCH, np.int64)])
    lo, hi = np.zeros(len(places), np.int64), np.full(len(places), len(tests.sa), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        p, t = places[open_], tests.sa[mid]
        k = common_words(text, p, items, t)
        less = items[t + k] < text[p + k]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    sides = [common_words(text, places, items, tests.sa[np.clip(side, 0, len(tests.sa) - 1)]) for side in (lo - 1, lo)]
    return np.maximum(*sides)


def occurrences(shard: Shard, tests: TestSet) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """For each window length: its words, places in the shard, which distinct window is there, items by window."""
    for size, rows, items in tests.by_length:
        q = shard.known(rows)
        able = np.flatnonzero((q > 0).all(1))
        if not able.size:
            continue
        lo, hi = search(shard.seq, shard.sa, q[able])
        times = hi - lo
        if times.sum():
            which = np.repeat(able, times)
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield size, shard.sa[np.repeat(lo, times) + within], which, items


def judge_places(data: np.ndarray, offs: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray, list[set[int]], np.ndarray, np.ndarray]:
    """Words of each row, a hit flag for each word, the items with an occurring window, longest match and its first place."""
    n = len(offs) - 1
    shard = Shard(data, offs, tests.depth)
    cover = np.zeros(len(shard.seq) + 1, np.int64)
    reach = np.zeros(len(shard.seq), np.int64)
    found: list[set[int]] = [set() for _ in range(n)]
    for size, places, which, items in occurrences(shard, tests):
        np.add.at(cover, places, 1)
        np.add.at(cover, places + size, -1)
        reach[places] = np.maximum(reach[places], size)
        for d, k in np.unique(np.stack([shard.doc[places], which], 1), axis=0).tolist():
            found[d].update(items[k])
    hit = np.cumsum(cover[:-1]) > 0
    at = np.flatnonzero(reach)
    far = longest_at(shard, tests, at)
    # below a whole window only items shorter than it count, as a whole
    far = np.where(far >= tests.window, far, reach[at])
    longest, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(longest, shard.doc[at], far)
    best = np.flatnonzero(far == longest[shard.doc[at]])[::-1]  # the first place is written last
    place[shard.doc[at[best]]] = at[best] - np.searchsorted(shard.doc, shard.doc[at[best]])
    return np.diff(shard.w.bounds), hit[shard.seq > 0], found, longest, place


class Least:
    """Smallest value of any stretch of an array, from minima over stretches of 1, 2, 4 ... values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            half, below = 2 ** (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(below[: len(below) - half], below[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values lo to hi - 1, for every pair (none is empty)."""
        level = np.log2(hi - lo).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            rows = level == k
            out[rows] = np.minimum(self.levels[k][lo[rows]], self.levels[k][hi[rows] - 2**k])
        return out


def longest_rows(data: np.ndarray, offs: np.ndarray, tests: TestSet, ids: list) -> Iterator[tuple[int, int, int, int, int]]:
    """For every test suffix: item, its place, the row and place of the longest match, and the match's words.

    Each suffix is searched once as a whole; the whole range of suffixes that tie for its longest match is then searched for
    the smallest id and place. No test suffix is written out, however long its item.
    """
    shard = Shard(data, offs, max(map(len, tests.items), default=1))
    ends = tests.seq == 0
    places = np.flatnonzero(~ends)
    if not len(places) or not len(shard.seq):
        return
    known = shard.known(tests.vocabulary)
    # unknown words and ends agree with nothing
    asked = np.concatenate([np.concatenate([[-2], np.where(known > 0, known, -2)])[tests.seq], np.full(STRETCH, -2, np.int64)])
    text = np.concatenate([shard.seq, np.full(STRETCH, -1, np.int64)])

    def bound(at: np.ndarray, limit: np.ndarray, upper: bool) -> np.ndarray:
        """First suffix not below (``upper``: above) the first ``limit`` words from each place."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(shard.sa), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            t, q = shard.sa[mid], at[open_]
            k = common_words(text, t, asked, q)
            less = np.where(k >= limit[open_], upper, text[t + k] < asked[q + k])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    at = bound(places, np.full(len(places), len(asked)), False)
    best = np.maximum(*[common_words(text, shard.sa[np.clip(side, 0, len(shard.sa) - 1)], asked, places) for side in (at - 1, at)])
    places, best = places[best > 0], best[best > 0]
    order = np.empty(len(ids), np.int64)
    order[sorted(range(len(ids)), key=lambda d: (ids[d] is not None, ids[d]))] = np.arange(len(ids))
    starts = np.searchsorted(shard.doc, np.arange(len(ids)))
    key = order[shard.doc] * len(shard.seq) + np.arange(len(shard.seq)) - starts[shard.doc]
    first = Least(key[shard.sa]).of(bound(places, best, False), bound(places, best, True))
    back = np.argsort(order)
    item = np.concatenate([[0], np.cumsum(ends)])[places]
    begin = np.concatenate([[0], np.flatnonzero(ends) + 1])
    for i, q, f, n in zip(item.tolist(), (places - begin[item]).tolist(), first.tolist(), best.tolist(), strict=True):
        yield i, q, int(back[f // len(shard.seq)]), f % len(shard.seq), n


def test_sets(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[TestSet]:
    """The test items in blocks of bounded text, read one block at a time.

    The number of blocks comes from the measured size; each block is one pass over the documents.
    """
    src = items.select(items[item_col].alias("i"), F.coalesce(items[text_col], F.lit("")).alias("t")).filter(F.length("t") > 0)
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        part = src if blocks == 1 else src.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        rows = part.orderBy("i", "t").collect()
        yield TestSet([r["i"] for r in rows], [r["t"] for r in rows], window)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, min_share: tuple[int, int] = (1, 20),
                  block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted as strings), longest_words, longest_place, contaminated.

    ``longest_words`` is the longest verbatim match with an item, of a window at least (or a whole shorter item), and
    ``longest_place`` the 0-based word at which it first begins.

    Each block of items is one pass over the documents, which carry the hit flags and items found so far; with more
    than one block the state is checkpointed between passes.
    """
    a, b = min_share
    state = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"),
                        F.lit(0).cast("long").alias("longest_words"), F.lit(None).cast("long").alias("longest_place"))
    kind = dict(state.dtypes)["id"]
    todo = test_sets(items, item_col, item_text_col, window, block_bytes)
    tests = next(todo, None) or TestSet([], [], window)
    while tests is not None:
        following = next(todo, None)
        state = state.mapInArrow(_pass(tests, following is None), f"id {kind}, text string, hits binary, items array<string>, longest_words long, longest_place long, n_words long, n_hit long").drop(
            *(["n_words", "n_hit"] if following is not None else ["text", "hits"]))
        if following is not None:
            state = cut(state)
        tests = following
    out = state.select("id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "longest_words", "longest_place")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (b * F.col("n_hit") >= a * F.col("n_words")))


def _pass(tests: TestSet, last: bool):
    """One pass: unites the flags of this block of items with those so far. The last leaves text and flags out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, offs in scan.pieces(batch.column(1)):
                part = batch.slice(x, y - x)
                n, hit, found, longest, place = judge_places(data, offs, tests)
                bounds = np.concatenate([[0], np.cumsum(n)])
                names = [{str(tests.ids[i]) for i in s} for s in found]
                for d, (before, old) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    if before.is_valid:
                        hit[bounds[d] : bounds[d + 1]] |= np.frombuffer(before.as_py(), np.uint8).astype(bool)
                        names[d].update(old.as_py())
                was = part.column(4).to_numpy()
                # an equally long match of an earlier block counts if it begins first
                first = [q if w > k or (w == k and w and q <= p) else p if k else None
                         for w, q, k, p in zip(was.tolist(), part.column(5).to_pylist(), longest.tolist(), place.tolist(), strict=True)]
                flags = [None] * (y - x) if last else [hit[bounds[d] : bounds[d + 1]].astype(np.uint8).tobytes() for d in range(y - x)]
                texts = pa.nulls(y - x, pa.string()) if last else part.column(1)
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[bounds])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), texts, pa.array(flags, pa.binary()), pa.array([sorted(s) for s in names], pa.list_(pa.string())),
                     pa.array(np.maximum(was, longest), pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64())],
                    ["id", "text", "hits", "items", "longest_words", "longest_place", "n_words", "n_hit"])

    return run


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """For every test suffix (item, word place): the longest verbatim match over all shards and where it stands.

    Ties go to the smallest document id (NULL first), then to the first place. Suffixes without any match are not listed. Each
    block of items is one pass over the documents, written before the next block is read.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind, ikind = dict(src.dtypes)["id"], dict(items.dtypes)[item_col]

    def scan_docs(tests: TestSet):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, y, data, offs in scan.pieces(batch.column(1)):
                    ids = batch.column(0).slice(x, y - x).to_pylist()
                    rows = [(tests.ids[i], j, ids[d], p, k) for i, j, d, p, k in longest_rows(data, offs, tests, ids)]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, batch.schema.field(0).type if n == 2 else None) for n, c in enumerate(zip(*rows, strict=True))],
                            ["item", "item_pos", "id", "doc_pos", "n_words"])

        return run

    out = None
    for tests in test_sets(items, item_col, item_text_col, WINDOW, block_bytes):
        found = src.mapInArrow(scan_docs(tests), f"item {ikind}, item_pos long, id {kind}, doc_pos long, n_words long")
        rank = F.struct(-F.col("n_words"), F.col("id"), F.col("doc_pos"))
        best = cut(found.groupBy("item", "item_pos").agg(F.min_by(F.struct("id", "doc_pos", "n_words"), rank).alias("m")).select("item", "item_pos", "m.*"))
        out = best if out is None else out.unionByName(best)
    return out
