"""Vectorised text scanning on Arrow buffers: words, lines and rolling hashes without a Python loop over rows.

Texts are UTF-8 bytes; all separators are ASCII, so bytes decide word boundaries. Hashes are polynomials over
2^64 with an odd base followed by a bijective mixer.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20


def tidy() -> None:
    """Give freed memory back: Spark keeps idle Python workers, and what their allocators hold counts as the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _table(ranges: Iterable[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, bool)
    for a, b in ranges:
        t[a : b + 1] = False
    return t


#: True for bytes of words ``[^\x20\x09-\x0D]+``.
PLAIN = _table([(0x20, 0x20), (0x09, 0x0D)])
#: True for bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (of lower-cased text).
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 65536)
        out = np.empty(size, U)
        out[0] = 1
        done, step = 1, base
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * U(step)
            done += more
            step = pow(base, done, 1 << 64)
        _powers[key] = have = out
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer; returns a new array."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial of the bytes; one entry more than bytes."""
    n = len(data)
    out = np.empty(n + 1, U)
    out[0] = 0
    v = data.astype(U)
    v += U(1)
    v *= _geometric(BASE, n)
    np.cumsum(v, out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    h = (pre[ends] - pre[starts]) * _geometric(INVERSE, len(pre))[starts]
    return mix(h ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93)))


def rolling_hash(pre: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of the ``size`` bytes at every place."""
    n = len(pre) - size
    h = pre[size:] - pre[:n]
    h *= _geometric(INVERSE, len(pre))[:n]
    h ^= U((size * 0xD6E8FEB86659FD93) % (1 << 64))
    return mix(h)


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, dat = col.buffers()
    if not len(col) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(dat, np.uint8)[offs[0] : offs[-1]] if dat is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def pieces(col, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of some ``size`` bytes (one row at least): first row, end row, bytes, offsets."""
    data, offs = utf8(col)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # first word of each row, and the number of words
    doc: np.ndarray
    hash: np.ndarray


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a row's start."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> Words:
    starts, ends = spans(kind[data], offs)
    bounds = np.searchsorted(starts, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    return Words(starts, ends, bounds, doc, span_hash(prefix(data), starts, ends))


def windows(values: np.ndarray, bounds: np.ndarray, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive values within a row, and where each starts.

    ``whole``: a row with fewer values, but not none, gives all of them as one window.
    """
    n = len(values)
    lengths = np.diff(bounds)
    left = np.repeat(bounds[1:], lengths) - np.arange(n)
    at = np.flatnonzero(left >= k)
    h = np.zeros(len(at), U)
    for j in range(k):
        h *= U(BASE)
        h += values[at + j]
    h = mix(h ^ U(k))
    if whole and (short := np.flatnonzero((lengths > 0) & (lengths < k))).size:
        more = np.empty(len(short), U)
        for size in np.unique(lengths[short]):
            rows = lengths[short] == size
            first = bounds[short[rows]]
            g = np.zeros(len(first), U)
            for j in range(size):
                g *= U(BASE)
                g += values[first + j]
            more[rows] = mix(g ^ U(size))
        at, h = np.concatenate([at, bounds[short]]), np.concatenate([h, more])
        order = np.argsort(at, kind="stable")
        at, h = at[order], h[order]
    return h, at


def in_row(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that also tell rows apart."""
    return mix(h ^ mix(doc.astype(U) + U(0x632BE59BD9B4E019)))


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned integers as byte planes of their differences; the highest, mostly small values, is compressed."""
    if not len(a):
        return b""
    d = np.diff(a, prepend=U(0))
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = d.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.uint32(len(a)).tobytes() + planes[:-1].tobytes() + zlib.compress(planes[-1].tobytes(), 1)


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, U)
    width, n = b[0], int(np.frombuffer(b, np.uint32, 1, 1)[0])
    low = (width - 1) * n
    d = np.zeros((n, 8), np.uint8)
    d[:, : width - 1] = np.frombuffer(b, np.uint8, low, 5).reshape(width - 1, n).T
    d[:, width - 1] = np.frombuffer(zlib.decompress(b[5 + low :]), np.uint8)
    return np.cumsum(d.view(U).ravel(), dtype=U)
