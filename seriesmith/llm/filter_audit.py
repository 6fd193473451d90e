"""How document filters overlap: what each of five filters removes, alone and behind the others, in every order.

Each text runs once through a byte transducer: three states (gap, in a word, in a character of several bytes) and six
byte classes index a table of outputs (word begins, word ends, capital, code point, symbol). Every class leads to one
state whatever the state before, so a byte's state is that of its predecessor's class and the whole run of texts is one
table lookup. Word spans go into an open hash table per run; a span counts as seen only where its bytes equal those of
the slot's owner, so distinct words rest on no hash.

Filters: A under ``min_words`` words; B distinct words under ``min_distinct_pct`` % of all; C capitals over
``max_capital_pct`` % of the code points; D any of ``#$%&*|``; E equal to the text of a smaller document id anywhere.
Each document becomes a five-bit mask. Per part only its counts by mask matter: 32 rows at most, from which the state
before every step of every order follows.

Defined cases: a null text is empty, a null part the empty string; empty texts equal each other; a document that
repeats its id and text is not behind itself; a null id is not compared (E passes) and has no labels; of several labels
of an id the largest hold; an empty table gives no rows; very long texts are scanned whole. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .common import stored

FILTERS = "ABCDE"
# byte classes
WHITE, LETTER, CAPITAL, SYMBOL, LEAD, CONT = range(6)
# states: between words, in a word after a whole character, in a word inside or after a character of several bytes
GAP, WORD, WIDE = range(3)
TARGET = np.array([GAP, WORD, WORD, WORD, WIDE, WIDE], np.uint8)
BEGIN, END, IS_CAPITAL, POINT, IS_SYMBOL = (1 << k for k in range(5))


def byte_classes() -> np.ndarray:
    t = np.full(256, LETTER, np.uint8)
    t[[0x20, *range(0x09, 0x0E)]] = WHITE
    t[0x41:0x5B] = CAPITAL
    t[list(b"#$%&*|")] = SYMBOL
    t[0x80:0xC0] = CONT
    t[0xC0:] = LEAD
    return t


def outputs() -> np.ndarray:
    """What each class puts out in each state."""
    out = np.zeros((3, 6), np.uint8)
    out[GAP, LETTER:] |= BEGIN
    out[[WORD, WIDE], WHITE] |= END
    out[:, CAPITAL] |= IS_CAPITAL
    out[:, SYMBOL] |= IS_SYMBOL
    out |= POINT
    out[WIDE, CONT] &= ~np.uint8(POINT)  # a continuation byte belongs to the character before it
    return out


CLASSES, OUTPUTS = byte_classes(), outputs()


def transduce(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The output of every byte; each row begins in the gap."""
    cls = CLASSES[data]
    before = np.empty(len(data), np.uint8)
    before[1:] = TARGET[cls[:-1]]
    before[offs[:-1][offs[:-1] < len(data)]] = GAP
    return OUTPUTS[before, cls]


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes at a equal those at b; long spans one by one, short ones together in bounded runs."""
    out = np.zeros(len(n), bool)
    long = np.flatnonzero(n > 64)
    for k in long:
        out[k] = np.array_equal(data[a[k] : a[k] + n[k]], data[b[k] : b[k] + n[k]])
    short = np.flatnonzero(n <= 64)
    for at in range(0, len(short), 1 << 15):
        rows = short[at : at + (1 << 15)]
        size = n[rows]
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        differs = data[np.repeat(a[rows], size) + step] != data[np.repeat(b[rows], size) + step]
        out[rows] = np.add.reduceat(differs, first) == 0
    return out


def first_of_each(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True for one span of each distinct (row, bytes): all spans enter an open table at once, those that meet a slot of
    other bytes go on to the next one."""
    n = len(starts)
    new = np.zeros(n, bool)
    if not n:
        return new
    key = scan.in_row(scan.span_hash(scan.prefix(data), starts, ends), row)
    mask = (1 << (2 * n).bit_length()) - 1
    owner = np.full(mask + 1, -1, np.int64)
    slot = (key & np.uint64(mask)).astype(np.int64)
    size = ends - starts
    waiting = np.arange(n)
    while waiting.size:
        free = waiting[owner[slot[waiting]] < 0]
        owner[slot[free]] = free
        holder = owner[slot[waiting]]
        won = holder == waiting
        new[waiting[won]] = True
        met, holder = waiting[~won], holder[~won]
        like = (row[met] == row[holder]) & (size[met] == size[holder]) & (key[met] == key[holder])
        like[like] = equal_spans(data, starts[met[like]], starts[holder[like]], size[met[like]])
        waiting = met[~like]
        slot[waiting] = (slot[waiting] + 1) & mask
    return new


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def count_rows(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    out = transduce(data, offs)
    summed = lambda bit: np.diff(np.concatenate([[0], np.cumsum(out & bit != 0, dtype=np.int64)])[offs])
    starts = np.flatnonzero(out & BEGIN)
    row = np.searchsorted(offs, starts, "right") - 1
    # a word ends at the next gap, or with its row
    stops = np.flatnonzero(out & END)
    gap = np.append(stops, len(data))[np.searchsorted(stops, starts, "right")]
    ends = np.minimum(gap, offs[row + 1])
    new = first_of_each(data, starts, ends, row)
    return {"n_words": np.bincount(row, minlength=n), "n_distinct": np.bincount(row[new], minlength=n),
            "n_capitals": summed(IS_CAPITAL), "n_points": summed(POINT), "n_symbols": summed(IS_SYMBOL)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in scan.pieces(batch.column(3)):
            got = count_rows(data, offs)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(got[c], pa.int64()) for c in COUNTS]], ["id", "part", "digest", *COUNTS])


def measure(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, part, digest (SHA-256 of the text) and the five counts of each document."""
    text = F.coalesce(docs[text_col], F.lit(""))
    src = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
                      F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return src.mapInArrow(_count, f"id {dict(src.dtypes)['id']}, part string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS))


def masks(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text",
          min_words: int = 50, min_distinct_pct: int = 65, max_capital_pct: int = 5) -> DataFrame:
    """id, part, mask (bit k: fails filter k) and how many rows of an id and part have it."""
    fails = [F.col("n_words") < min_words, F.col("n_distinct") * 100 < F.col("n_words") * min_distinct_pct,
             F.col("n_capitals") * 100 > F.col("n_points") * max_capital_pct, F.col("n_symbols") > 0]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = measure(docs, id_col, part_col, text_col).select("id", "part", "digest", mask.alias("mask"))
    # repeated rows collapse before any join
    rows = stored(rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    # the first document of a text is met by id and text together: a large group of copies is dealt out by its ids
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    judged = rows.join(first, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(copy, 16).otherwise(0))
    return judged.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def part_counts(judged: DataFrame, labels: DataFrame, label_id_col: str = "doc_id") -> DataFrame:
    """part, mask, and documents: n, good (quality 1), toxic."""
    marks = labels.select(labels[label_id_col].alias("id"), (labels["quality"] == 1).alias("q"), (labels["toxic"] == 1).alias("t")).filter("id is not null")
    marks = marks.groupBy("id").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    judged = stored(judged, "judged")
    none = F.lit(None).cast("boolean")
    known = judged.filter("id is not null").join(marks, "id", "left").select("part", "mask", "n", "q", "t")
    every = known.union(judged.filter("id is null").select("part", "mask", "n", none.alias("q"), none.alias("t")))  # null ids meet nothing
    at = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), at("q").alias("good"), at("t").alias("toxic"))


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, f (the step's filter) and seen (bits of the filters before it): 600 rows."""
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    rows = spark.range(1).select(orders).select("filter_order", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("step"))
    bit = "aggregate(sequence(0, 4), 0, (a, k) -> a + if(instr(substring(filter_order, 1, step - 1), char(65 + k)) > 0, shiftleft(1, k), 0))"
    return rows.withColumn("f", F.ascii(F.expr("substring(filter_order, step, 1)")) - 65).withColumn("seen", F.expr(bit))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley (removed at any step, summed over all orders)."""
    spark = docs.sparkSession
    counts = part_counts(masks(docs, id_col, part_col, text_col, **limits), labels)
    # every mask (32) behind every set of earlier filters before every other filter: 2560 rows, whatever the input
    met = spark.range(32 * 32 * 5).select((F.col("id") % 32).cast("int").alias("mask"), (F.floor(F.col("id") / 32) % 32).cast("int").alias("seen"),
                                          F.floor(F.col("id") / 1024).cast("int").alias("f")).withColumn("bit", F.expr("shiftleft(1, f)")).filter("seen & bit = 0")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("seen")) > 0
    total = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    # of the 120 orders a filter is the first of the k that a document fails in 120 / k
    share = F.sum(F.when(fails, (F.col("n") * 120 / F.bit_count("mask")).cast("long")).otherwise(0)).cast("long")
    effects = counts.join(F.broadcast(met), "mask").groupBy("part", "seen", "f").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"), share.alias("shapley"))
    return effects.join(F.broadcast(steps(spark)), ["seen", "f"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
