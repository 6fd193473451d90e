"""Global counts of hashed items, asked for and answered per block of documents.

Documents are dealt to blocks by a hash. A block sends each distinct item once, with its count, to the item's
bucket (a range of hashes), so a frequent item costs one entry per block and no task gets more than its share;
buckets add the counts and answer every block. The block then reads its documents again (the same exchange) and
sees the global counts of all its items, aligned with its own sorted items.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import shuffle_partitions


def blocked(docs: DataFrame, id_col: str, text_col: str, n_blocks: int | None = None) -> DataFrame:
    """blk, id, text. As many blocks as two for each shuffle partition unless given."""
    n = n_blocks or 2 * shuffle_partitions(docs.sparkSession)
    key = F.pmod(F.xxhash64(docs[id_col], docs[text_col]), F.lit(n)).cast("int")
    return docs.select(key.alias("blk"), docs[id_col].alias("id"), docs[text_col].alias("text"))


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned counts as compressed byte planes."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def unsqueeze(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(zlib.decompress(b[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def cuts(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted keys of so many bits."""
    edge = np.array([(i << bits) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])


@dataclass
class Items:
    """What a block asks for: sorted distinct keys of so many bits, and how often it has each."""

    keys: np.ndarray
    counts: np.ndarray
    bits: int


REQUEST = pa.schema([("bucket", pa.int32()), ("blk", pa.int32()), ("total", pa.list_(pa.int64())), ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])
RESPONSE = pa.schema([("blk", pa.int32()), ("bucket", pa.int32()), ("total", pa.list_(pa.int64())), ("counts", pa.list_(pa.binary()))])
ASKED = "bucket int, blk int, total array<long>, keys array<binary>, counts array<binary>"
ANSWERED = "blk int, bucket int, total array<long>, counts array<binary>"


def requests(blk: int, kinds: list[Items], buckets: int) -> pa.Table:
    """One row per bucket with the keys of all kinds; empty parts too, so that a block learns every bucket's total."""
    at = [cuts(k.keys, k.bits, buckets) for k in kinds]
    rows: dict[str, list] = {"bucket": list(range(buckets)), "blk": [blk] * buckets, "total": [], "keys": [], "counts": []}
    for i in range(buckets):
        parts = [slice(a[i], a[i + 1]) for a in at]
        rows["total"].append([int(k.counts[p].sum()) for k, p in zip(kinds, parts, strict=True)])
        rows["keys"].append([scan.pack_sorted(k.keys[p]) for k, p in zip(kinds, parts, strict=True)])
        rows["counts"].append([squeeze(k.counts[p]) for k, p in zip(kinds, parts, strict=True)])
    return pa.table(rows, REQUEST)


def exchange(docs: DataFrame, ask: Callable[[pa.Table], list[Items]], use: Callable[[pa.Table, list[np.ndarray], list[int]], pa.Table],
             schema: str, code: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``ask`` gives a block's items, kind by kind; ``use`` gets the block again with the global counts of those items.

    ``docs`` comes from ``blocked``. ``code`` turns global counts into what is sent back. ``use`` also gets, for each
    kind, the sum of all counts.
    """
    buckets = shuffle_partitions(docs.sparkSession)

    def asking(t: pa.Table) -> pa.Table:
        out = requests(t.column("blk")[0].as_py(), ask(t), buckets)
        scan.tidy()
        return out

    def answering(t: pa.Table) -> pa.Table:
        totals, keys, counts = (t.column(c).to_pylist() for c in ("total", "keys", "counts"))
        kinds = len(totals[0])
        answers: list[list[bytes]] = [[] for _ in totals]
        whole = []
        for kind in range(kinds):
            part = [scan.unpack_sorted(k[kind]) for k in keys]
            number = np.concatenate([unsqueeze(c[kind]) for c in counts])
            _, back = np.unique(np.concatenate(part), return_inverse=True)
            total = np.bincount(back, number).astype(np.int64)[back]
            whole.append(int(number.sum()))
            if code:
                total = code(total)
            ends = np.cumsum([len(k) for k in part])
            for row, a, b in zip(answers, ends - [len(k) for k in part], ends, strict=True):
                row.append(squeeze(total[a:b]))
        return pa.table({"blk": t.column("blk"), "bucket": t.column("bucket"), "total": [whole] * len(answers), "counts": answers}, RESPONSE)

    def using(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(*(right.column(c).to_pylist() for c in ("bucket", "total", "counts")), strict=True), key=lambda r: r[0])
        kinds = len(rows[0][1])
        out = use(left, [np.concatenate([unsqueeze(c[k]) for _, _, c in rows]) for k in range(kinds)], [sum(t[k] for _, t, _ in rows) for k in range(kinds)])
        scan.tidy()
        return out

    asked = docs.groupBy("blk").applyInArrow(asking, ASKED)
    answered = asked.groupBy("bucket").applyInArrow(answering, ANSWERED)
    return docs.groupBy("blk").cogroup(answered.groupBy("blk")).applyInArrow(using, schema)
