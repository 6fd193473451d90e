"""Suffix-array deduplication: every byte goes that a 50-byte string covers which also starts in an earlier document.

Earlier means a smaller id; strings are judged on the input and never cross documents. Three rounds of questions over
one shuffle of the texts (``rounds``):

1. Every 50-byte window has an anchor, the smallest hash of its 24-byte strings; windows in a row with the same anchor
   form a context. Equal windows have equal anchors, so contexts whose anchor occurs once in the corpus are done.
2. The others ask how often their whole context occurs, and in which smallest document. If an anchor always has the
   same context, the answer holds for all its windows.
3. Windows of contexts that differ somewhere (the borders of copied passages, and edits) are sorted by suffix arrays
   of the block's texts (``lyndon``: linear grouping by Lyndon prefixes), which bring equal windows together, whatever
   follows; each distinct window asks for the smallest document that has it.

A string that very many documents share costs one question per block, wherever it is.

Defined cases: null text counts as empty; a text shorter than the window keeps all; a null id comes after all others
and doesn't remove from other null ids; rows with equal ids don't remove from each other; an empty table gives an
empty table; ids are integers; extra columns are not read. Hashes that decide have 56 bits or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import blocks, lyndon, rounds, scan
from .blocks import squeeze, unsqueeze

LENGTH = 50
ANCHOR = 24
LAST = np.iinfo(np.uint64).max
#: Texts of a suffix array have about so many bytes; longer pieces are cut with the overlap that windows need.
SHARD = 600
#: So many suffix arrays are made in step; a block's memory doesn't grow with the bytes that it has to sort.
TOGETHER = 2000


def ranks(ids) -> np.ndarray:
    """Unsigned numbers in the order of the ids; a null is the largest."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    plain = pc.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = plain.view(np.uint64) ^ np.uint64(1 << 63)
    out[pc.is_null(ids).to_numpy(zero_copy_only=False)] = LAST
    return out


def settled(t: pa.Table) -> pa.Table:
    """The block in an order that doesn't depend on how the shuffle delivered it."""
    t = t.set_column(t.schema.get_field_index("text"), "text", pc.fill_null(t.column("text"), ""))
    return t.take(pc.sort_indices(t, [("id", "ascending"), ("text", "ascending")]))


class Contexts:
    """The contexts of one run of texts: row, first and last window, anchor key."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int, anchor: int):
        n, wide = len(data), length - anchor + 1
        self.data, self.offs, self.length, self.pre = data, offs, length, scan.prefix(data)
        windows = max(0, n - length + 1)
        if not windows:
            self.row = self.first = self.last = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        low = scan.rolling_hash(self.pre, anchor)
        span = 1
        while 2 * span <= wide:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        rest = wide - span
        low = np.minimum(low[:windows], low[rest : rest + windows])
        new = np.empty(windows, bool)
        np.not_equal(low[1:], low[:-1], out=new[1:])
        able = np.diff(offs) >= length
        new[offs[:-1][able]] = True
        # windows that reach into the next row, or start in a row too short for any
        long = np.where(able, length - 1, np.diff(offs))
        outside = lyndon.spread(offs[1:] - long, long)
        new[outside[outside < windows]] = False
        self.first = np.flatnonzero(new)
        # smallest hashes are small: mixed again, so that every bucket gets as many keys
        self.key = scan.mix(low[self.first])
        self.row = np.searchsorted(offs, self.first, "right") - 1
        self.last = np.minimum(np.append(self.first[1:], n) - 1, offs[self.row + 1] - length)

    def whole(self, which: np.ndarray | slice) -> np.ndarray:
        """56-bit keys of whole contexts."""
        return scan.span_hash(self.pre, self.first[which], self.last[which] + self.length) >> np.uint64(8)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of the contexts, and their 56-bit keys."""
        starts = lyndon.spread(self.first[which], self.last[which] - self.first[which] + 1)
        return starts, scan.span_hash(self.pre, starts, starts + self.length) >> np.uint64(8)


def runs(t: pa.Table, length: int, anchor: int):
    """Row offset in the block and contexts, run by run."""
    for a, _, data, offs in scan.pieces(t.column("text")):
        yield a, Contexts(data, offs, length, anchor)


def grouped(keys: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their numbers and smallest values."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    head = np.flatnonzero(new)
    return keys[head], np.diff(np.append(head, len(keys))), np.minimum.reduceat(least[order], head) if len(head) else least


def sorted_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """56-bit keys of the distinct windows of some spans of ``data`` and the smallest value of each.

    The spans are cut into texts of a shard's size; every shard has its own suffix array, so a window may come once
    per shard. Shards are sorted some at a time.
    """
    step = SHARD - length
    many = np.maximum(1, -(-(ends - starts - length + 1) // step))
    a = np.repeat(starts, many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * step
    b = np.minimum(a + step + length - 1, np.repeat(ends, many))
    values = np.repeat(values, many)
    size = b - a + 1  # with the mark that ends a piece
    shard = (np.cumsum(size) - size) // SHARD
    cut = np.flatnonzero(np.diff(shard // TOGETHER, prepend=-1, append=-1)) if len(a) else []
    keys, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        found = _sorted_shards(data[lyndon.spread(a[x:y], b[x:y] - a[x:y])], b[x:y] - a[x:y], values[x:y], shard[x:y], length)
        keys.append(found[0])
        low.append(found[1])
    return np.concatenate(keys), np.concatenate(low)


def _sorted_shards(data: np.ndarray, size: np.ndarray, values: np.ndarray, shard: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for pieces of these sizes, which follow each other in ``data``."""
    a = np.cumsum(size) - size
    last = np.append(shard[1:] != shard[:-1], True)
    total = size + 1 + last
    begin = np.cumsum(total) - total
    text = np.ones(int(total.sum()), np.int64)
    place = np.full(len(text), -1, np.int64)
    inner = lyndon.spread(begin, size)
    text[inner] = data.astype(np.int64) + 2
    bounds = np.concatenate([[0], (begin + total)[last]])
    text[bounds[1:] - 1] = 0
    able = size - length + 1
    place[lyndon.spread(begin, able)] = lyndon.spread(a, able)
    value = np.zeros(len(text), np.uint64)
    value[inner] = np.repeat(values, size)
    order = lyndon.suffix_order(text, bounds)
    order = order[place[order] >= 0]
    at = place[order]
    new = np.ones(len(order), bool)
    new[1:] = np.searchsorted(bounds, order[1:], "right") != np.searchsorted(bounds, order[:-1], "right")
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    for i in range(1, len(at), 1 << 16):
        part = slice(i, min(len(at), i + (1 << 16)))
        new[part] |= (view[at[part]] != view[at[part.start - 1 : part.stop - 1]]).any(1)
    head = np.flatnonzero(new)
    return scan.span_hash(scan.prefix(data), at[head], at[head] + length) >> np.uint64(8), np.minimum.reduceat(value[order], head)


def dedup_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, spans (start and end of each removed run), kept (bytes)."""
    src = blocks.blocked(docs, id_col, text_col)

    def anchors(t: pa.Table) -> rounds.Question:
        keys = np.concatenate([np.zeros(0, np.uint64), *[c.key >> np.uint64(24) for _, c in runs(settled(t), length, anchor)]])
        distinct, counts = np.unique(keys, return_counts=True)
        return rounds.Question(distinct, counts, np.zeros(len(distinct), np.uint64), 40)

    def contexts(t: pa.Table, told: rounds.Answer) -> rounds.Question:
        t = settled(t)
        rank = ranks(t.column("id"))
        got = [(c.key >> np.uint64(24), c.whole(slice(None)), rank[a + c.row]) for a, c in runs(t, length, anchor)]
        key, whole, values = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        times = told.counts[np.unique(key, return_inverse=True)[1]] if len(key) else np.zeros(0, np.int64)
        shared = times > 1
        distinct, counts, least = grouped(whole[shared], values[shared])
        flags = np.packbits(shared).tobytes()
        return rounds.Question(distinct, counts, least, 56, np.uint32([len(shared), len(flags)]).tobytes() + flags + squeeze(times[shared]))

    def windows(t: pa.Table, told: rounds.Answer) -> rounds.Question:
        t = settled(t)
        rank = ranks(t.column("id"))
        n, size = np.frombuffer(told.memo, np.uint32, 2)
        shared = np.unpackbits(np.frombuffer(told.memo, np.uint8, size, 8))[:n].astype(bool)
        times = unsqueeze(told.memo[8 + size :])
        got, keys, row, done = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
        for a, c in runs(t, length, anchor):
            which = np.flatnonzero(shared[done : done + len(c.key)])
            done += len(c.key)
            keys.append(c.whole(which))
            row.append(rank[a + c.row[which]])
            got.append((c.data, c.row[which], c.first[which], c.last[which] + length))
        back = np.unique(np.concatenate(keys), return_inverse=True)[1]
        same = told.counts[back] == times if len(back) else np.zeros(0, bool)
        gone = same & (told.least[back] < np.concatenate(row)) if len(back) else same
        pieces, sizes, values, done = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        for (data, doc, first, end), ranked in zip(got, row[1:], strict=True):
            mixed = np.flatnonzero(~same[done : done + len(first)])
            done += len(first)
            if not mixed.size:
                continue
            # contexts that follow each other make one span
            new = np.ones(len(mixed), bool)
            new[1:] = (first[mixed[1:]] != end[mixed[:-1]] - length + 1) | (doc[mixed[1:]] != doc[mixed[:-1]])
            at = np.flatnonzero(new)
            ends = end[mixed[np.append(at[1:], len(mixed)) - 1]]
            starts = first[mixed[at]]
            pieces.append(data[lyndon.spread(starts, ends - starts)])
            sizes.append(ends - starts)
            values.append(ranked[mixed[at]])
        data, size = np.concatenate(pieces), np.concatenate(sizes)
        del got, pieces, keys, row, back
        distinct, counts, least = grouped(*sorted_windows(data, np.cumsum(size) - size, np.cumsum(size), np.concatenate(values), length))
        flags = np.zeros(n, np.uint8)
        flags[shared] = np.where(same, gone, 2)
        return rounds.Question(distinct, counts, least, 56, squeeze(flags))

    def cover(t: pa.Table, told: rounds.Answer) -> pa.Table:
        t = settled(t)
        rank = ranks(t.column("id"))
        flags = unsqueeze(told.memo)
        got, keys, done = [], [np.zeros(0, np.uint64)], 0
        for a, c in runs(t, length, anchor):
            flag = flags[done : done + len(c.key)]
            done += len(c.key)
            starts, k = c.windows(np.flatnonzero(flag == 2))
            keys.append(k)
            gone = np.flatnonzero(flag == 1)
            got.append((a, c.data, c.offs, c.first[gone], c.last[gone] + length, starts))
        back = np.unique(np.concatenate(keys), return_inverse=True)[1]
        del keys
        out, done = [], 0
        for a, data, offs, first, end, starts in got:
            mine = told.least[back[done : done + len(starts)]] if len(starts) else np.zeros(0, np.uint64)
            done += len(starts)
            row = np.searchsorted(offs, starts, "right") - 1
            starts = starts[mine < rank[a + row]]
            change = np.zeros(len(data) + 1, np.int64)
            for begin, stop in ((first, end), (starts, starts + length)):
                np.add.at(change, begin, 1)
                np.add.at(change, stop, -1)
            removed = np.cumsum(change[:-1]) > 0
            n = len(offs) - 1
            s, e = scan.spans(removed, offs)
            at = np.searchsorted(s, offs)
            row = np.repeat(np.arange(n), np.diff(at))
            pairs = np.stack([s - offs[row], e - offs[row]], 1).reshape(-1)
            kept = np.concatenate([[0], np.cumsum(~removed)])[offs]
            out.append(pa.table({
                "id": t.column("id").slice(a, n), "n_bytes": np.diff(offs), "n_removed": np.diff(offs) - np.diff(kept),
                "spans": pa.ListArray.from_arrays(pa.array(2 * at, pa.int32()), pa.array(pairs, pa.int64())),
                "kept": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(data[~removed].tobytes())])}))
        return pa.concat_tables(out)

    told = rounds.ask_again(src, rounds.ask_again(src, rounds.ask(src, anchors), contexts), windows)
    return rounds.finish(src, told, cover, f"id {dict(src.dtypes)['id']}, n_bytes long, n_removed long, spans array<long>, kept binary")
