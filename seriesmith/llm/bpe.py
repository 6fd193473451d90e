"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of code-point classes. The pre-tokenisation rules are an automaton of eight states; each
character is a function from states to states, and functions compose associatively, so a blocked prefix scan over
the (small, finite) set of composed functions gives the state before every character without a regex. Pieces are
then byte slices; equal slices are merged once per run of texts and kept in a bounded cache.

Defined cases: null and empty texts have no ids and decode to no bytes; a piece of any length is merged whole (by a
heap, in n log n); special tokens don't exist; repeated rows are encoded each; extra columns are not read. The rank
file's content (a fixed vocabulary of some hundred kilobytes) is sent to the tasks.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scan

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# The code points with the White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Letters and numbers of Unicode 16, which this interpreter's tables may not have yet.
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
               (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
               (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
               (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
               (0x1E5F1, 0x1E5FA)]

#: States: after a letter, number or other character; after a space that joins what follows; in white space;
#: one or two letters of a contraction missing; nothing open.
L, N, O, P, W, C1, C2, E = range(8)  # noqa: E741
#: Symbols: letter, number, other, joining space, white space, lone white space before text, apostrophe of a
#: contraction of one or two letters, start of a text.
SYMBOLS = 9


def _rule(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins before the symbol."""
    if symbol == 0:
        return {C2: C1, C1: E}.get(state, L), state not in (L, P, C1, C2)
    if symbol in (1, 2):
        return symbol, state not in (symbol, P)
    if symbol == 3:
        return P, True
    if symbol == 4:
        return W, state != W
    if symbol == 5:
        return E, True
    if symbol in (6, 7):
        return (O, False) if state in (O, P) else (C1 if symbol == 6 else C2, True)
    return E, False


class Automaton:
    """The closure of the symbols' functions under composition, as a multiplication table."""

    def __init__(self):
        table = [[_rule(s, y) for s in range(8)] for y in range(SYMBOLS)]
        self.begins = np.array([[b for _, b in row] for row in table])
        identity = tuple(range(8))
        known = {identity: 0}
        for row in table:
            known.setdefault(tuple(s for s, _ in row), len(known))
        steps = [tuple(s for s, _ in row) for row in table]
        todo = list(known)
        while todo:
            f = todo.pop()
            for g in steps:
                if (h := tuple(g[s] for s in f)) not in known:
                    known[h] = len(known)
                    todo.append(h)
        functions = list(known)
        self.size = len(functions)
        self.apply = np.array(functions, np.uint8)
        self.times = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16).ravel()
        self.of = np.array([known[g] for g in steps], np.uint16)

    def prefix(self, f: np.ndarray, width: int = 256) -> np.ndarray:
        """For each place, the composition of all functions up to and including it."""
        n = len(f)
        if n <= 64:
            out = f.copy()
            for i in range(1, n):
                out[i] = self.times[int(out[i - 1]) * self.size + int(f[i])]
            return out
        rows = -(-n // width)
        grid = np.zeros(rows * width, np.uint16)
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, width).T)
        size = np.uint16(self.size)
        wide = self.size > 255
        for j in range(1, width):
            left = grid[j - 1].astype(np.uint32) * np.uint32(self.size) if wide else grid[j - 1] * size
            grid[j] = self.times[left + grid[j]]
        before = np.zeros(rows, np.uint16)
        before[1:] = self.prefix(grid[-1])[:-1]
        grid = self.times[before.astype(np.uint32)[None, :] * np.uint32(self.size) + grid]
        return grid.T.reshape(-1)[:n]

    def boundaries(self, symbols: np.ndarray) -> np.ndarray:
        state = self.apply[self.prefix(self.of[symbols]), E]
        before = np.empty_like(state)
        before[:1] = E
        before[1:] = state[:-1]
        return self.begins[symbols, before]


_shared: dict[str, object] = {}


def automaton() -> Automaton:
    if "automaton" not in _shared:
        _shared["automaton"] = Automaton()
    return _shared["automaton"]


def classes() -> np.ndarray:
    """The class of every code point, by general category."""
    if "classes" not in _shared:
        cat = unicodedata.category
        kind = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kind.get(cat(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        for new, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
            for a, b in ranges:
                t[a : b + 1] = new
        t[WHITE] = SPACE
        _shared["classes"] = t
    return _shared["classes"]


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte places where a piece begins, over all rows of a run."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offs)] = True  # rows' first characters, and the end
    white = kind == SPACE
    text_next = np.zeros(n, bool)
    text_next[:-1] = ~white[1:]
    text_next &= ~first[1:]
    sym = kind.copy()
    sym[white] = 4
    sym[white & text_next] = 5
    sym[(points == 32) & text_next] = 3
    quote = np.flatnonzero((points == 39) & ~first[1:])
    if quote.size:
        follow = points[np.minimum(quote + 1, n - 1)]
        second = points[np.minimum(quote + 2, n - 1)]
        has_two = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        sym[quote[np.isin(follow, [115, 116, 109, 100])]] = 6
        pair = follow.astype(np.int64) * 256 + np.minimum(second, 255)
        sym[quote[has_two & np.isin(pair, [114 * 256 + 101, 118 * 256 + 101, 108 * 256 + 108])]] = 7
    rows = np.unique(np.searchsorted(at, offs[:-1]))
    rows = rows[rows < n]
    shifted = np.arange(n) + np.cumsum(first[:n])
    whole = np.full(n + len(rows), SYMBOLS - 1, np.uint8)
    whole[shifted] = sym
    return at[automaton().boundaries(whole)[shifted]]


class Coder:
    """Ranks with their pair table, a cache of merged pieces and the bytes of each id."""

    CACHE = 200_000

    def __init__(self, content: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for k, v in self.ranks.items():
            tokens[v] = k
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, int] = {}

    def ready(self) -> Coder:
        """With the tables for encoding, which decoding does without."""
        if self.pairs:
            return self
        get = self.ranks.get
        self.pairs = {(a << 20) | b: v for k, v in self.ranks.items() for i in range(1, len(k))
                      if (a := get(k[:i])) is not None and (b := get(k[i:])) is not None}
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        return self

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the pair of the lowest rank, the leftmost of equals, until none is left."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        ids = [self.single[b] for b in piece]
        if len(ids) > 100:
            return self._merge_long(ids)
        get, none = self.pairs.get, 1 << 30
        rank = [get((a << 20) | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while rank and (m := min(rank)) < none:
            i = rank.index(m)
            ids[i] = m
            del ids[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get((m << 20) | ids[i + 1], none)
            if i:
                rank[i - 1] = get((ids[i - 1] << 20) | m, none)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one side has been merged since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := get((r << 20) | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            h = before[i]
            if h >= 0 and (s := get((ids[h] << 20) | r)) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return tuple(x for x in ids if x >= 0)

    def encode_rows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a run, and the bounds of each row's ids."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        starts = piece_starts(data, offs)
        ends = np.append(starts[1:], len(data))
        _, index, back = np.unique(scan.span_hash(scan.prefix(data), starts, ends), return_index=True, return_inverse=True)
        buf, cache = data.tobytes(), self.cache
        if len(cache) > self.CACHE:
            cache.clear()
        merged = []
        for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True):
            piece = buf[a:b]
            got = cache.get(piece)
            if got is None:
                got = self.merge(piece)
                if b - a <= 64:
                    cache[piece] = got
            merged.append(got)
        count = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(chain.from_iterable(merged), np.uint32, int(count.sum()))
        each = count[back]
        ids = flat[spread(np.cumsum(count)[back] - each, each)]
        total = np.concatenate([[0], np.cumsum(each)])
        return ids, total[np.searchsorted(starts, offs)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and the byte offset where each id's bytes begin (and the end)."""
        size = self.lengths[ids]
        return self.bytes[spread(self.starts[ids], size)], np.concatenate([[0], np.cumsum(size)])


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _coder(content: bytes) -> Coder:
    if _shared.get("content") != content:
        _shared["content"], _shared["coder"] = content, Coder(content)
    return _shared["coder"]


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """id, n_tokens and ids (little-endian unsigned 32-bit integers, as binary) of each document.

    ``with_offsets`` adds, in the same form, the byte place in the text where each id's bytes begin: any run of ids
    can then be cut from the text itself.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(held.value).ready()
        for batch in batches:
            for a, b, data, offs in scan.pieces(batch.column(1)):
                ids, bounds = coder.encode_rows(data, offs)
                raw = ids.astype("<u4").tobytes()
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds), pa.int64()), sliced(raw, bounds * 4)]
                if with_offsets:
                    size = coder.lengths[ids]
                    begin = np.cumsum(size) - size
                    begin -= np.repeat(offs[:-1], np.diff(bounds))
                    cols.append(sliced(begin.astype("<u4").tobytes(), bounds * 4))
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids", *["offsets"] * with_offsets])
        coder.cache.clear()  # Spark keeps idle workers: leave them small
        scan.tidy()

    kind = dict(src.dtypes)["id"]
    return src.mapInArrow(run, f"id {kind}, n_tokens long, ids binary" + ", offsets binary" * with_offsets)


def sliced(raw: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array over one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``, to what ``encode`` returns."""
    held = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(held.value)
        for batch in batches:
            for a, b, data, offs in scan.pieces(batch.column(2)):
                out, begin = coder.decode(np.frombuffer(data.tobytes(), "<u4"))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, sliced(out.tobytes(), begin[offs // 4])], [*batch.schema.names, "decoded"])
        scan.tidy()

    schema = ", ".join(f"{c} {t}" for c, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")
