"""Whitening of embeddings on their leading principal components.

Entries become whole numbers x = floor(64 c) + 1000000. The covariance V of x (divisor n, centred before multiplying) is
never formed: Chebyshev-filtered subspace iteration multiplies a block Q of ``components + guard`` columns by V in passes
over all vectors, ``X'(XQ) / n`` with X centred, each partition summing its own share.

1. Lanczos passes with one vector bound the spectrum from below.
2. Each round filters the block with the Chebyshev polynomial that is small between that bound and the block's smallest
   Ritz value (the unwanted spectrum) and grows fast above it; the recurrence takes one pass per degree. Columns that
   have converged are locked and projected out of every step, so that a dominant one does not drown the others.
3. QR and a Rayleigh-Ritz step on locked and active columns together give the new Ritz pairs. Some guard columns are
   drawn anew every round, which would bring up any direction that the block missed.
4. Certified: the residuals of all wanted pairs are at rounding level, or small and no longer falling. Without that after
   ``max_rounds`` it is an error, never a silent result.

Only matrices of dimension x block meet the driver: one per partition up to ``FAN_IN`` partitions, beyond that sums of
their groups. They grow with the dimension, not with the vectors.

Defined cases: a null vector, or one with a null, NaN or infinite entry, is dropped (from the fit too); repeated rows and
null ids are rows like others; components whose eigenvalue is under 1e-10 of the trace can't be whitened and are left
out (all of them where all vectors are equal); a dimension under ``components`` gives so many components; no vectors, or
empty ones, give no rows; vectors of different lengths are an error; a deviation beyond 64 bits is null. Columns other
than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

OFFSET = 1_000_000
#: Up to so many partitions send their share of a product to the driver; more are summed in groups first.
FAN_IN = 64
#: Growth of the largest active column over the smallest wanted one in one filter.
MAX_SPREAD = 1e8
MAX_DEGREE = 30
RESULT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of packed whole numbers as a matrix."""
    if not len(col):
        return np.zeros((0, dim), np.int64)
    return np.frombuffer(b"".join(col.to_pylist()) if col.offset else memoryview(col.buffers()[2])[: len(col) * dim * 8], np.int64).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(1)
        size = len(x.flatten()) // len(x) if len(x) else 0
        if len(x) and not (np.diff(x.offsets.to_numpy()) == size).all():
            raise ValueError("vectors of different lengths")
        raw = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)).tobytes()
        at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (size * 8))
        packed = pa.Array.from_buffers(pa.binary(), len(x), [None, at.buffers()[1], pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), size, np.int32)), packed], ["id", "dim", "x"])


def packed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, dim and x (64-bit whole numbers) of the usable vectors, written once."""
    c = vectors[vector_col]
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.filter(c.isNotNull() & ~bad & (F.size(c) > 0)).select(
        vectors[id_col].alias("id"), F.transform(c, lambda v: F.floor(v.cast("double") * 64).cast("long") + OFFSET).alias("x"))
    return stored(rows.mapInArrow(_pack, f"id {dict(rows.dtypes)['id']}, dim int, x binary"), "vectors")


class Passes:
    """Sums over all vectors, as functions of small matrices."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("x")
        sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.min("dim").alias("a"), F.max("dim").alias("b")).first()
        self.n, self.dim = sizes["n"], sizes["b"] or 0
        if sizes["a"] != sizes["b"]:
            raise ValueError("vectors of different lengths")
        if not self.n:
            return
        dim = self.dim

        def sums(batches):
            total = np.zeros(dim, np.int64)
            for batch in batches:
                total += _matrix(batch.column(0), dim).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["s"])

        per_task = stored(self.rows.mapInArrow(sums, "s array<long>"), "sums")
        self.tasks = per_task.count()
        by_dim = per_task.select(F.posexplode("s").alias("j", "s")).groupBy("j").agg(F.sum("s").alias("s")).orderBy("j").collect()
        self.sums = np.array([r["s"] for r in by_dim], np.int64)
        self.count = 0

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n, the whole part first, so that no digits of the offset are lost."""
        whole = self.sums // self.n
        rest = (self.sums - whole * self.n) / self.n
        return lambda x: (x - whole).astype(np.float64) - rest

    def add(self, share: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all vectors of ``share(centred block)``."""
        dim, centre = self.dim, self.centre()

        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                x = _matrix(batch.column(0), dim)
                for at in range(0, len(x), 8192):
                    total += share(centre(x[at : at + 8192]))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        parts = self.rows.mapInArrow(run, "m binary")
        if self.tasks > FAN_IN:
            def fold(group: pa.Table) -> pa.Table:
                total = sum((np.frombuffer(b, np.float64) for b in group.column("m").to_pylist()), np.zeros(int(np.prod(shape))))
                return pa.table({"m": pa.array([total.tobytes()], pa.binary())})

            parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(int(self.tasks**0.5)))).applyInArrow(fold, "m binary")
        self.count += 1
        got = [np.frombuffer(r["m"], np.float64) for r in parts.collect()]
        return np.sum(got, axis=0).reshape(shape)

    def times(self, q: np.ndarray) -> np.ndarray:
        """V Q: one pass."""
        return self.add(lambda x: x.T @ (x @ q), q.shape) / self.n


def low_edge(apply: Callable[[np.ndarray], np.ndarray], dim: int, rng: np.random.Generator, steps: int = 8) -> float:
    """A lower bound of the spectrum: the smallest value of a short Lanczos run less its residual, and not under zero."""
    q = rng.standard_normal((dim, 1))
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, dim)):
        w = apply(basis[-1])
        alpha.append((basis[-1].T @ w).item())
        for b in basis:  # twice is enough to stay orthogonal
            w = w - b * (b.T @ w)
        for b in basis:
            w = w - b * (b.T @ w)
        beta.append(np.linalg.norm(w).item())
        if beta[-1] <= 1e-12 * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    k = len(alpha)
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))
    return max(0.0, values[0] - beta[-1] * abs(vectors[-1, 0]))


def chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, degree: int, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of the given degree that is small on [low, high] and 1 at ``top``, applied to q."""
    centre, half = (low + high) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (apply(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def leading_pairs(apply: Callable[[np.ndarray], np.ndarray], dim: int, trace: float, components: int, guard: int = 16,
                  max_rounds: int = 60, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``components`` eigenvalues, falling, and their unit eigenvectors; ``apply`` multiplies a block by V."""
    rng = np.random.default_rng(seed)
    k, m = min(components, dim), min(dim, components + guard)
    if trace <= 0:
        return np.zeros(0), np.zeros((dim, 0))
    low = low_edge(apply, dim, rng) if m < dim else 0.0
    q = np.linalg.qr(rng.standard_normal((dim, m)))[0]
    last = np.inf
    for _ in range(max_rounds):
        vq = apply(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        rest = np.linalg.norm(vq - q * values, axis=0)
        rounding = 1e-13 * values[0]
        wanted = rest[:k].max()
        if wanted <= rounding or wanted <= 1e-11 * values[0] and wanted > last / 2:
            return values[:k], q[:, :k]
        last = wanted
        fixed = int(np.argmax(np.append(rest[:k] > rounding, True)))  # converged from the top on
        locked, active = q[:, :fixed], q[:, fixed:]
        if guard >= 8 and m < dim:
            active = np.hstack([active[:, : m - fixed - 2], rng.standard_normal((dim, 2))])
        free = lambda z: z - locked @ (locked.T @ z)  # noqa: B023, E731
        step = lambda z: free(apply(z))  # noqa: B023, E731
        active = free(free(active))
        high = low + 0.95 * (values[m - 3 if guard >= 8 and m < dim else -1] - low)
        top = values[fixed]
        if high - low <= 1e-9 * top:  # nothing to damp but null directions
            active = step(active)
        else:
            reach = lambda v: np.arccosh(max((2 * v - high - low) / (high - low), 1 + 1e-9))  # noqa: B023, E731
            need = np.log(wanted / rounding * 10) / reach(values[k - 1])
            spread = np.log(MAX_SPREAD) / max(reach(top) - reach(values[k - 1]), 1e-9)
            degree = int(np.clip(min(need, spread), 2, MAX_DEGREE))
            active = chebyshev(step, active / np.linalg.norm(active, axis=0), low, high, degree, top)
        active = np.linalg.qr(free(active))[0]
        q = np.linalg.qr(np.hstack([locked, free(active)]))[0]
    raise RuntimeError(f"no certified eigenvectors after {max_rounds} rounds: residual {last:g}")


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = packed(vectors, id_col, vector_col)
    schema = RESULT.format(id=dict(rows.dtypes)["id"])
    passes = Passes(rows)
    if not passes.n:
        return rows.sparkSession.createDataFrame([], schema)
    n, dim, sums = passes.n, passes.dim, passes.sums
    trace = passes.add(lambda x: np.array([(x * x).sum()]), (1,)).item() / n
    values, axes = leading_pairs(passes.times, dim, trace, components)
    usable = values > 1e-10 * trace
    values, axes = values[usable], axes[:, usable]
    scale, k = axes / np.sqrt(values), len(values)
    moments = passes.add(lambda x: (lambda y: np.vstack([y.T @ y, y.sum(0)]))(x @ scale), (k + 1, k))
    mean = moments[k] / n
    error = float(np.abs(moments[:k] / n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    explained = (values / trace).tolist()
    centre = passes.centre()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            white = centre(x) @ scale
            # n x - S = n (x - w) - (S - n w) with the whole part w of the mean: exact, and as small as it can be
            whole = sums // n
            low, rest = x - whole, sums - whole * n
            if float(np.abs(low).max(initial=0)) * n + n < (2**63 / dim) ** 0.5:
                off = low * n - rest
                deviation = pa.array((off * off).sum(1), pa.int64())
            else:
                exact = [sum((int(a) * n - int(r)) ** 2 for a, r in zip(v, rest, strict=True)) for v in low]
                deviation = pa.array([d if d < 2**63 else None for d in exact], pa.int64())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(white).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["vec_id", "deviation", "white"])

    out = rows.select("id", "x").mapInArrow(project, f"vec_id {dict(rows.dtypes)['id']}, deviation long, white array<double>")
    return out.select("vec_id", "deviation", F.posexplode("white").alias("p", "whitened")).select(
        "vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*[F.lit(e) for e in explained]), F.col("p") + 1).alias("explained"), F.lit(error).alias("identity_error"))
