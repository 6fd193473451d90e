"""N-gram Jaccard join: size-aware, heavy and light, exact.

A document's set holds its distinct five-word shingles. Two sets link when 100 * intersection >= 80 * union (the
share is a parameter). The work:

1. Shingle frequencies come from a block exchange (``blocks``). A set is ordered by rising frequency; if its prefix
   of n - ceil(0.8 n) + 1 shingles has none that another document shares, it has no partner and is done.
2. Equal sets become one class; only classes go on.
3. Small sets (n up to a boundary) emit all subsets of the size that a link with a partner of each possible size
   needs: sets that share such a subset link for certain, so a star per subset is enough. Large sets meet in the
   inverted lists of their prefixes. The boundary minimises the counted cost of both: subsets to emit against list
   entries to scan.
4. Lists are first met by their smallest member only, and verified links are contracted to components; then only
   list members of different components meet each other, until none is left untested. No link between components
   can be lost, as every pair that shares a prefix shingle is either tested or already connected.

Defined cases: a text of fewer than five words is one shingle; null, empty or word-less text has an empty set, links
with nothing and is its own component; repeated rows are classes' members like copies; equal ids on several rows are
separate rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut
from . import blocks, scan
from .common import stored
from .components import connected_components

K = 5
KEY_BITS = 40  # frequencies only order shingles: a shared key can make one look more frequent, never wrong
ENUMERABLE = 24


def required(a, b, pct: int):
    """The smallest intersection with which sets of sizes a and b link."""
    return -(-pct * (a + b) // (100 + pct))


def sizes_that_link(n: int, pct: int) -> range:
    return range(-(-pct * n // 100), 100 * n // pct + 1)


def subsets_of(n: int, pct: int) -> int:
    """How many subsets a set of size n emits."""
    return sum(comb(n, required(n, m, pct)) for m in sizes_that_link(n, pct) if required(n, m, pct) <= n)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and shingles, each once per row, by row."""
    w = scan.words(scan.LOWER[data], offs, scan.PLAIN)
    h, at = scan.windows(w.hash, w.bounds, k, whole=True)
    doc = w.doc[at]
    _, once = np.unique(scan.in_row(h, doc), return_index=True)
    once.sort()
    return doc[once], h[once]


def _block_sets(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, _, data, offs in scan.pieces(table.column("text")):
        d, h = shingle_sets(data, offs, k)
        docs.append(d + a)
        hashes.append(h)
    return np.concatenate(docs), np.concatenate(hashes)


def frequency_code(df: np.ndarray) -> np.ndarray:
    """Eighths of the binary logarithm: 0 for a shingle of one document."""
    return np.minimum(255, np.rint(8 * np.log2(df))).astype(np.int64)


SETS = "n long, hi long, lo long, alone long, shared boolean, cost double, prefix binary, shingles binary"


def signed(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


def document_sets(docs: DataFrame, id_col: str, text_col: str, k: int, pct: int) -> DataFrame:
    """id, size, signature; for sets that may have a partner their shared prefix and, once per block, the set."""
    src = blocks.blocked(docs, id_col, text_col)
    kind = dict(src.dtypes)["id"]
    src = src.withColumn("id", F.col("id").cast(kind))  # fields of a struct as nullable as the schema below says

    def ask(t: pa.Table) -> list[blocks.Items]:
        _, h = _block_sets(t, k)
        return [blocks.Items(*np.unique(h >> np.uint64(64 - KEY_BITS), return_counts=True), KEY_BITS)]

    def use(t: pa.Table, answers: list, totals: list) -> pa.Table:
        rows = t.num_rows
        doc, h = _block_sets(t, k)
        code = np.zeros(0, np.int64)
        if len(h):
            keys = h >> np.uint64(64 - KEY_BITS)
            code = answers[0][np.searchsorted(np.unique(keys), keys)]
        order = np.lexsort((h, code, doc))
        doc, h, code = doc[order], h[order], code[order]
        bounds = np.searchsorted(doc, np.arange(rows + 1))
        n = np.diff(bounds)
        sums = []
        for salt in (0x51ED270B, 0x2545F4914F6CDD1D):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scan.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
            sums.append(total[bounds[1:]] - total[bounds[:-1]])
        reach = n - (-(-pct * n // 100)) + 1
        alone = np.concatenate([[0], np.cumsum(code == 0)])
        alone = alone[bounds[1:]] - alone[bounds[:-1]]
        shared = (n > 0) & (alone < reach)
        weight = np.concatenate([[0.0], np.cumsum(np.exp2(code / 8))])
        hi, lo = signed(sums[0]), signed(sums[1])
        prefix, sets, cost, seen = [None] * rows, [None] * rows, np.zeros(rows), set()
        for i in np.flatnonzero(shared).tolist():
            if (hi[i], lo[i]) in seen:
                continue
            seen.add((hi[i], lo[i]))
            a, b = bounds[i], bounds[i] + reach[i]
            prefix[i] = h[a:b][code[a:b] > 0].tobytes()
            cost[i] = weight[b] - weight[a]
            sets[i] = np.sort(h[a : bounds[i + 1]]).tobytes()
        return pa.table([t.column("id"), pa.array(n), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(alone), pa.array(shared), pa.array(cost),
                         pa.array(prefix, pa.binary()), pa.array(sets, pa.binary())], ["id", *[c.split(" ")[0] for c in SETS.split(", ")]])

    return blocks.exchange(src, ask, use, f"id {kind}, {SETS}", frequency_code)


def boundary(classes: DataFrame, pct: int) -> int:
    """The largest size whose sets emit subsets: the cheapest split of counted subsets and list entries."""
    rows = classes.filter(F.col("n") <= ENUMERABLE).groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum("cost").alias("s")).collect()
    count, scans = {r["n"]: r["c"] for r in rows}, {r["n"]: r["s"] for r in rows}
    best, at = None, 0
    for x in range(ENUMERABLE + 1):
        emit = sum(subsets_of(n, pct) * c for n, c in count.items() if n <= x)
        scanned = sum(s for n, s in scans.items() if 100 * n >= pct * (x + 1))
        if best is None or emit + scanned < best:
            best, at = emit + scanned, x
    return at


def _emit_subsets(pct: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, bool, int]] = []
            for node, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = np.frombuffer(raw, np.uint64)
                for m in sizes_that_link(n, pct):
                    c = required(n, m, pct)
                    if c > n or m > top:
                        continue
                    rows = h[np.array(list(combinations(range(n), c)))] if c else np.zeros((1, 0), np.uint64)
                    key = np.full(len(rows), (min(n, m) << 32) + max(n, m), np.uint64)
                    for j in range(rows.shape[1]):
                        key = scan.mix(key * np.uint64(scan.BASE) + rows[:, j])
                    out += [(x, 0 if n == m else 1 if n < m else 2, node) for x in signed(key)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["key", "side", "node"])

    return run


def subset_links(classes: DataFrame, pct: int, top: int) -> DataFrame:
    """Star pairs of small sets that share a subset of the size their link needs."""
    rows = cut(classes.filter(F.col("n") <= top).select("node", "n", "shingles").mapInArrow(_emit_subsets(pct, top), "key long, side int, node long").distinct())
    least = rows.groupBy("key").agg(*[F.min(F.when(F.col("side") == s, F.col("node"))).alias(f"m{s}") for s in range(3)])
    met = rows.join(least, "key")
    pivot = F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    return met.select("node", pivot.alias("pivot")).filter("pivot is not null and node <> pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _emit_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """List entries of prefixes: shingle, class, its size, the shingle's place in its order and its share of unshared shingles."""
    for batch in batches:
        node, n, alone = (batch.column(i).to_numpy() for i in range(3))
        data, offs = scan.utf8(batch.column(3))
        each = np.diff(offs) // 8
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - alone, each)
        cols = [np.frombuffer(data.tobytes(), np.int64), np.repeat(node, each), np.repeat(n, each), place, np.repeat(1000 * alone // np.maximum(n, 1), each)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "node", "n", "place", "odd"])


def verified(pairs: DataFrame, classes: DataFrame, pct: int) -> DataFrame:
    """a, b, linked for each distinct pair of classes, by exact intersection."""
    sets = classes.select("node", "shingles")
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, ao = scan.utf8(batch.column(2))
            b, bo = scan.utf8(batch.column(3))
            ha, hb = np.frombuffer(a.tobytes(), np.uint64), np.frombuffer(b.tobytes(), np.uint64)
            ao, bo = ao // 8, bo // 8
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = ha[ao[i] : ao[i + 1]], hb[bo[i] : bo[i + 1]]
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * common >= pct * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])
        scan.tidy()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _may_link(pct: int):
    """Sizes, and what can still follow the two places in the common order, allow a link.

    At the first shingle that two linked sets share in that order this always holds.
    """
    return (100 * F.least("n", "m") >= pct * F.greatest("n", "m")) & (
        (100 + pct) * F.least(F.col("n") - F.col("place"), F.col("m") - F.col("place2")) >= pct * (F.col("n") + F.col("m")))


def class_components(classes: DataFrame, pct: int) -> DataFrame:
    """node, component of all classes that have a link."""
    top = boundary(classes, pct)
    postings = cut(classes.filter(100 * F.col("n") >= pct * (top + 1)).select("node", "n", "alone", "prefix").mapInArrow(
        _emit_postings, "h long, node long, n long, place long, odd long"))
    # the centre of a list is the member with the smallest share of shingles that no one else has: of variants of one
    # text it is the one nearest to all; lists of one class can't link
    centre = postings.groupBy("h").agg(F.min(F.struct("odd", "n", "node", "place")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    centre = centre.select("h", F.col("p.n").alias("m"), F.col("p.node").alias("pivot"), F.col("p.place").alias("place2"))
    stars = postings.join(centre, "h").filter((F.col("node") != F.col("pivot")) & _may_link(pct))
    pairs = stars.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).union(subset_links(classes, pct, top)).distinct()
    tested = cut(verified(pairs, classes, pct))
    known = tested.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    comp = cut(connected_components(known))
    held = postings.join(comp, "node", "left").select("h", "node", "n", "place", F.coalesce("component", "node").alias("comp"))
    mixed = held.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("h")
    open_ = cut(held.join(mixed, "h", "left_semi"))
    other = open_.select("h", F.col("node").alias("node2"), F.col("n").alias("m"), F.col("comp").alias("comp2"), F.col("place").alias("place2"))
    met = open_.join(other, "h").filter((F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")) & _may_link(pct))
    rest = met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    more = cut(verified(cut(rest), classes, pct).filter("linked").select("a", "b"))
    if more.isEmpty():
        return comp
    # the links between components are few: contracted, they join what is connected already
    of = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("u"), F.coalesce("of_b", "b").alias("v"))
    joined = cut(connected_components(ends))
    moved = comp.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    single = joined.join(comp.select("node"), "node", "left_anti")
    return moved.select("node", F.coalesce("to", "component").alias("component")).union(single.select("node", "component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, pct: int = 80) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    sets = stored(document_sets(docs, id_col, text_col, k, pct), "ngram-sets")
    shared = sets.filter("shared")
    least = shared.groupBy("hi", "lo").agg(F.min("id").alias("least"))
    whole = sets.filter(F.col("shingles").isNotNull()).dropDuplicates(["hi", "lo"]).select("hi", "lo", "n", "alone", "cost", "prefix", "shingles")
    classes = stored(whole.withColumn("node", F.monotonically_increasing_id()), "ngram-classes")
    comp = class_components(classes, pct)
    named = classes.select("hi", "lo", "node").join(comp, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("comp"))
    named = cut(named.join(least, ["hi", "lo"]))
    ids = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_class = named.join(ids, "comp").select("hi", "lo", "component_id")
    out = sets.select("id", "n", "hi", "lo", "shared")
    linked = out.filter("shared").join(of_class, ["hi", "lo"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return linked.union(out.filter("not shared").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
