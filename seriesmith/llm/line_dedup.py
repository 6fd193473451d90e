"""Line deduplication by a deletion-neighbourhood join, with built-in functions only.

A line goes if an equal line stands earlier, and one of at least ``min_chars`` characters also if a line within one edit
(a character inserted, deleted or replaced) does; earlier means a smaller document id, then an earlier line. Lines are
judged on the input, not on what is left. Blank lines (only spaces, tabs and the like) stay.

1. Equal lines collapse by a 128-bit hash in one map-side combined aggregate; the earliest place stays.
2. Two lines within one edit share a first or last half up to a shift by one, and of the other half a half again.
   Lines that share no such part with another line are done; only the few others go on, and only their texts are
   fetched.
3. Those emit every variant with one character deleted, as a hashed key that also has the place of the deletion: equal
   keys mean that one replacement, or none, tells the lines apart, so each meets only the earliest of its key. A line
   also emits itself, which meets the variants of lines longer by one. Long lines are hashed in blocks of about the
   square root of their length, so that a line of n characters costs n^1.5, not n^2.
4. The edit distance of each such pair is verified on the texts.

Defined cases: a null text stays null and has no lines; an empty text has one blank line; null ids come first; rows
that repeat an id and text are the same document and are judged alike; rows with equal ids but other texts are
separate documents, ordered by a hash; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import cut
from .common import stored

MIN_CHARS = 20
#: Up to so many keys of lines (8 bytes each) are broadcast to fetch texts; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def documents(docs: DataFrame, id_col: str, text_col: str, keep_cols: Sequence[str] = ()) -> DataFrame:
    kept = [docs[c].alias(f"kept_{c}") for c in keep_cols]
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("dk"), *kept)


def lines(src: DataFrame) -> DataFrame:
    """One row per line: its document, place, text and 128-bit hash."""
    out = src.select("id", "dk", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return out.withColumns({"n": F.length("line"), "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")})


def _sizes(n: Column) -> list[Column]:
    """Half the length of a string, as it may be for one longer or shorter by a character."""
    return [F.floor(n / 2).cast("int"), F.when(n % 2 == 0, n / 2 - 1).otherwise((n + 1) / 2).cast("int")]


def _half_keys(text: Column, n: Column, *within: Column) -> list[tuple[Column, Column]]:
    """Hashes of the first and last half at both lengths, each with what of the text it leaves out."""
    out = []
    for x in _sizes(n):
        out.append((F.xxhash64(*within, F.lit(1), x, text.substr(F.lit(1), x)), text.substr(x + 1, n)))
        out.append((F.xxhash64(*within, F.lit(2), x, text.substr(n - x + 1, x)), text.substr(F.lit(1), n - x)))
    return out


HALVES = ("pa", "sa", "pb", "sb")


def written(line: Column) -> Column:
    """Whether a text has anything but white space."""
    return line.rlike(r"[^\x20\x09-\x0D]")


def classes(src: DataFrame, min_chars: int) -> DataFrame:
    """Distinct lines that are not blank: hash, earliest place, and half keys of those long enough."""
    rows = lines(src).filter(written(F.col("line")))
    long = F.col("n") >= min_chars
    rows = rows.withColumns({k: F.when(long, h) for k, (h, _) in zip(HALVES, _half_keys(F.col("line"), F.col("n")), strict=True)})
    return rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "dk", "pos")).alias("first"), *[F.min(k).alias(k) for k in HALVES])


def candidates(found: DataFrame) -> DataFrame:
    """Distinct lines that share a half with another: h1, h2 and the earliest place."""
    keys = found.filter(f"{HALVES[0]} is not null").select("h1", "h2", F.explode(F.array(*HALVES)).alias("k"))
    shared = keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k")
    near = keys.join(shared, "k", "left_semi").select("h1", "h2").distinct()
    return found.select("h1", "h2", "first").join(near, ["h1", "h2"], "left_semi")


def with_text(src: DataFrame, near: DataFrame, min_chars: int) -> DataFrame:
    """The candidates with their text, read at their earliest place, and a number that rises with that place."""
    wanted = near.select("h1").distinct()
    if near.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    rows = lines(src).filter(F.col("n") >= min_chars).join(wanted, "h1", "left_semi")
    met = rows.join(near.select("h1", "h2", "first"), ["h1", "h2"]).filter(F.struct("id", "dk", "pos").eqNullSafe(F.col("first")))
    ordered = met.select("first", "line", "n", "h1", "h2").dropDuplicates(["h1", "h2"]).orderBy("first")
    return cut(ordered.withColumn("node", F.monotonically_increasing_id()).drop("first"))


def narrowed(texts: DataFrame) -> DataFrame:
    """Of the candidates those that also share a half of the other half: one edit leaves three quarters alike."""
    halves = [F.struct(h.alias("h"), rest.alias("rest")) for h, rest in _half_keys(F.col("line"), F.col("n"))]
    quarters = [k for k, _ in _half_keys(F.col("rest"), F.length("rest"), F.col("h"))]
    keys = texts.select("node", F.inline(F.array(*halves))).select("node", F.explode(F.array(*quarters)).alias("k")).distinct()
    shared = keys.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k")
    return cut(texts.join(keys.join(shared, "k", "left_semi").select("node").distinct(), "node", "left_semi"))


def _block(m: Column) -> Column:
    return F.greatest(F.lit(32), F.floor(F.sqrt(m))).cast("int")


def _key(t: Column, m: Column, before: Column, middle: Column, after: Column) -> Column:
    return F.xxhash64(t, m, before, middle, after)


def variants(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletion variants (key, place, node) and the lines themselves (key, node).

    The key of a string of m characters at block t hashes what stands before the block, the block, and what follows.
    """
    line = F.col("line")
    cut_in = texts.select("node", "line", (F.col("n") - 1).alias("m")).withColumn("b", _block(F.col("m")))
    blocks = cut_in.select("node", "m", "b", "line", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / F.col("b")).cast("int"))).alias("t"))
    at = F.col("t") * F.col("b")
    blocks = blocks.select("node", "m", "b", "t", F.xxhash64(line.substr(F.lit(1), at)).alias("before"), line.substr(at + 1, F.col("b") + 1).alias("part"),
                           F.xxhash64(line.substr(at + F.col("b") + 2, F.col("m") + 1)).alias("after"))
    # deletion i of the block: the part without that character; the last block ends with the line
    blocks = blocks.withColumn("last", F.least(F.col("b"), F.length("part")) - 1).filter("last >= 0")
    shorter = F.expr("transform(sequence(0, last), i -> struct(t * b + i as place, concat(substring(part, 1, i), substring(part, i + 2, b + 1)) as middle))")
    gone = blocks.select("node", "m", "t", "before", "after", F.inline(shorter))
    gone = gone.select("node", "place", _key(F.col("t"), F.col("m"), F.col("before"), F.col("middle"), F.col("after")).alias("key"))
    own = texts.select("node", "line", F.col("n").alias("m")).withColumn("b", _block(F.col("m")))
    own = own.select("node", "m", "b", "line", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / F.col("b")).cast("int"))).alias("t"))
    own = own.select("node", _key(F.col("t"), F.col("m"), F.xxhash64(line.substr(F.lit(1), at)), line.substr(at + 1, F.col("b")),
                                  F.xxhash64(line.substr(at + F.col("b") + 1, F.col("m") + 1))).alias("key"))
    return gone, own


def near_pairs(gone: DataFrame, own: DataFrame) -> DataFrame:
    """later, earlier: each line with the earliest of every key it shares; enough to tell which lines go.

    A key's lines are the texts that lose one character to become the same string, some for each place and character,
    so the list of one key is bounded by its length; lists of one line, nearly all, end here.
    """
    rows = gone.select("key", "place", "node").union(own.select("key", F.lit(-1).alias("place"), "node"))
    met = rows.groupBy("key").agg(F.collect_list(F.struct("place", "node")).alias("of")).filter(F.array_min("of.node") < F.array_max("of.node"))
    met = cut(met.select("key", F.inline("of")))
    gone, own = met.filter("place >= 0"), met.filter("place < 0").select("key", F.col("node").alias("short"))
    replaced = gone.groupBy("key", "place").agg(F.min("node").alias("earlier"))
    by_replacing = gone.join(replaced, ["key", "place"]).select(F.col("node").alias("later"), "earlier")
    # a shorter line goes if the earliest of those longer by one is before it, and a longer one if the shorter is
    longer = gone.groupBy("key").agg(F.min("node").alias("least"))
    from_longer = own.join(longer, "key").select(F.col("short").alias("later"), F.col("least").alias("earlier"))
    from_shorter = gone.join(own, "key").select(F.col("node").alias("later"), F.col("short").alias("earlier"))
    return by_replacing.union(from_longer).union(from_shorter).filter("earlier < later").distinct()


def near_copies(src: DataFrame, found: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2 of distinct lines that an earlier line within one edit replaces, verified on the texts."""
    texts = with_text(src, cut(candidates(found)), min_chars)
    texts = narrowed(texts)
    pairs = near_pairs(*variants(texts))
    left = texts.select(F.col("node").alias("later"), F.col("line").alias("x"), "h1", "h2")
    right = texts.select(F.col("node").alias("earlier"), F.col("line").alias("y"))
    met = pairs.join(left, "later").join(right, "earlier")
    return met.filter(F.levenshtein("x", "y", 1) >= 0).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                keep_cols: Sequence[str] = (), min_left: float = 0.0) -> DataFrame:
    """One row per document row: id, text of the lines that stay, n_lines, n_removed, and ``keep_cols`` as they are.

    Where something, but less than the share ``min_left`` of the characters would stay, the text is left whole: such a
    document is nearly a copy, and what is left of it could no longer be recognised as one.
    """
    src = documents(docs, id_col, text_col)
    found = stored(classes(src, min_chars), "lines")
    near = near_copies(src, found, min_chars)
    stay = found.join(near, ["h1", "h2"], "left_anti").select("first.id", "first.dk", "first.pos", F.lit(True).alias("keep"))
    every = src.select("id", "dk", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("id", "dk", "pos", (~written(F.col("line"))).alias("keep"))
    flags = every.union(stay).groupBy("id", "dk", "pos").agg(F.max("keep").alias("keep"))
    flags = flags.groupBy(F.col("id").alias("fid"), F.col("dk").alias("fdk")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "keep"))).alias("flags"), F.count_if(~F.col("keep")).alias("n_removed"))
    whole = documents(docs, id_col, text_col, keep_cols)
    met = whole.join(flags, F.col("dk").eqNullSafe(F.col("fdk")) & F.col("id").eqNullSafe(F.col("fid")), "left")
    parts = F.arrays_zip(F.split("text", "\n").alias("line"), F.col("flags.keep").alias("keep"))
    kept = F.array_join(F.transform(F.filter(parts, lambda p: p["keep"]), lambda p: p["line"]), "\n")
    whole = (F.coalesce("n_removed", F.lit(0)) == 0) | (written(F.col("stays")) & (F.length("stays") < min_left * F.length("text")))
    return met.withColumn("stays", kept).select("id", F.when(whole, F.col("text")).otherwise(F.col("stays")).alias("text"),
                      F.when(F.col("text").isNull(), 0).otherwise(F.size("flags")).cast("long").alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), *[F.col(f"kept_{c}").alias(c) for c in keep_cols])
