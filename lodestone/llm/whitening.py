"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found from passes over the table that multiply centred XᵀX by a narrow
block: a Chebyshev recurrence damps the unwanted end of the spectrum, QR makes the block orthonormal, Rayleigh-Ritz reads
the eigenvalues, until the residuals certify every wanted pair. The covariance itself is never formed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokens import sums

OUT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, id_col: str, vec_col: str, scale: float, shift: int) -> DataFrame:
    """(id, x): floor(scale * c) + shift of each entry, of the rows whose vector has entries, all of them finite."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            size = np.nan_to_num(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            flat = col.flatten()
            c = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            bad = sums(~np.isfinite(c), np.r_[0, np.cumsum(size)])
            keep = (size > 0) & (bad == 0)
            c = c[np.repeat(keep, size)]
            if np.abs(c).max(initial=0.0) * scale >= 2.0**52:
                raise OverflowError("whitening: entries are too large for exact integers")
            x = np.floor(scale * c).astype(np.int64) + shift
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[keep])].astype(np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), lists], ["id", "x"])

    return vectors.select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(go, f"id {kind}, x array<bigint>")


def _packed(rows: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.column(0).slice(lo, rows)
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([part.flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())], ["n", "data"])

    return go


class Fit:
    """The fit list as packed blocks of rows, and passes over it whose results are small arrays summed over all tasks."""

    def __init__(self, distinct: DataFrame, dim: int, most: int, rows: int = 2048, task_bytes: int = 32 << 20):
        """most: a number of rows that distinct does not exceed. A pass has a task for each task_bytes of the list, or for each core if that is more."""
        cores = distinct.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, math.ceil(most * dim * 8 / task_bytes), min(cores, math.ceil(most / rows)))
        self.blocks = cut(distinct.select("x").coalesce(tasks).mapInArrow(_packed(rows), "n long, data binary"))
        self.dim = dim
        self.tasks = self.blocks.rdd.getNumPartitions()
        self.n, self.total = 0, [0] * dim
        for r in self._summed(lambda x: np.r_[len(x), x.sum(axis=0)], dtype=np.int64):
            self.n += int(r[0])
            self.total = [a + int(b) for a, b in zip(self.total, r[1:], strict=True)]
        self.trace, self.most = 0.0, 0
        if self.n:
            got = list(self._summed(lambda x: np.array([(x * x).sum()]), centred=True))
            self.trace = float(np.sum(got)) / self.n

    def _summed(self, part: Callable, centred: bool = False, dtype: type = np.float64) -> list[np.ndarray]:
        """part(rows) summed over the blocks of a task, and over the tasks in groups of about their square root; the groups' sums."""
        n, dim = getattr(self, "n", 0), self.dim
        total = np.array(self.total, np.int64) if centred else None

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for data in b.column(1):
                    x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dim)
                    one = part((n * x - total) / n if centred else x)
                    out = one if out is None else out + one
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(out, dtype).tobytes()], pa.binary())], ["sum"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for b in batches:
                for data in b.column(0):
                    one = np.frombuffer(data.as_buffer(), dtype)
                    out = one if out is None else out + one
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sum"])

        got = self.blocks.mapInArrow(go, "sum binary")
        if self.tasks > 64:
            got = got.repartition(math.isqrt(self.tasks)).mapInArrow(add, "sum binary")
        return [np.frombuffer(r[0], dtype) for r in got.collect()]

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q: one pass."""
        got = self._summed(lambda x: (x.T @ (x @ q)).ravel(), centred=True)
        return np.sum(got, axis=0).reshape(q.shape) / self.n

    def covariance_of(self, p: np.ndarray) -> np.ndarray:
        """Covariance of the rows after projection on p: one pass."""
        k = p.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            w = x @ p
            return np.r_[w.sum(axis=0), (w.T @ w).ravel()]

        got = np.sum(self._summed(part, centred=True), axis=0) / self.n
        return got[k:].reshape(k, k) - np.outer(got[:k], got[:k])


def least_edge(times: Callable[[np.ndarray], np.ndarray], dim: int, steps: int, seed: int) -> float:
    """A bound below a symmetric matrix's eigenvalues, none of them negative: the least Ritz value of a few Lanczos steps less its residual's norm."""
    q = np.random.default_rng(seed).standard_normal((dim, 1))
    basis, diagonal, beside = q / np.linalg.norm(q), [], [0.0]
    for _ in range(min(steps, dim)):
        w = times(basis[:, -1:])
        diagonal.append((basis[:, -1:].T @ w).item())
        for _ in range(2):
            w -= basis @ (basis.T @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-14 * max(map(abs, diagonal)):
            break
        basis = np.c_[basis, w / beside[-1]]
    m = len(diagonal)
    ritz = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(beside[1:m], 1) + np.diag(beside[1:m], -1))
    return max(0.0, float(ritz[0]) - beside[m])


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], dim: int, k: int, block: int, degree: int, tolerance: float, most_rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix without negative ones, falling, and their unit vectors.

    times(q) is the matrix times q. Ends when every wanted residual is at most tolerance times its eigenvalue (or what
    rounding leaves of the largest one); RuntimeError if that takes more than most_rounds rounds of `degree` passes.
    """
    block = min(dim, block)
    low = least_edge(times, dim, 12, seed + 1) if block < dim else 0.0
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, block)))
    for _ in range(most_rounds):
        w = times(q)
        h = q.T @ w
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        worst = np.linalg.norm(w - q * value, axis=0)[:k]
        if (worst <= np.maximum(tolerance * value[:k], 1e-14 * value[0])).all():
            return value[:k], q[:, :k]
        high = max(value[-1], low + 1e-9 * value[0])  # what lies between low and the block's least value is damped
        middle, half = (high + low) / 2, (high - low) / 2
        sigma = first = half / (value[0] - middle)
        now, last = (w - middle * q) * (sigma / half), q
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            now, last = (times(now) - middle * now) * (2 * after / half) - sigma * after * last, now
            sigma = after
        q, _ = np.linalg.qr(now)
    raise RuntimeError(f"whitening: residual {worst.max():.3g} after {most_rounds} rounds; largest eigenvalue {value[0]:.3g}")


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, scale: float = 64.0, shift: int = 1_000_000,
    block: int = 32, degree: int = 10, tolerance: float = 1e-13, most_rounds: int = 100, seed: int = 11,
) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries have no rows. Entries count as the integers
    floor(scale * c) + shift. The model is fitted to each distinct vector once, so that copies have no weight; rows that
    repeat an id, and null ids, have rows of their own. There are at most as many components as entries. A component whose
    eigenvalue is zero (under 1e-13 of the trace) whitens to 0 and is no part of identity_error. Vectors of several
    lengths raise ValueError; integers whose exact results do not fit 64 bits, OverflowError. No vectors: no rows.
    """
    out = OUT.format(vectors.schema[id_col].dataType.simpleString())
    base = integers(vectors, id_col, vec_col, scale, shift)
    distinct = base.select("x").distinct()
    sizes = [r[0] for r in base.select(F.size("x")).distinct().limit(2).collect()]
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out)
    if len(sizes) > 1:
        raise ValueError(f"whitening: vectors of several lengths, {sizes[0]} and {sizes[1]} among them")
    dim = sizes[0]
    fit = Fit(distinct, dim, vectors.count())
    n, total, trace = fit.n, np.array(fit.total, np.int64), fit.trace
    k = min(components, dim)
    value, q = leading_pairs(fit.times, dim, k, max(block, 2 * k), degree, tolerance, most_rounds, seed)
    real = value > 1e-13 * trace
    p = q * np.where(real, 1 / np.sqrt(np.where(real, value, 1.0)), 0.0)
    share = np.where(real, value / trace if trace else 0.0, 0.0)
    error = float(np.abs(fit.covariance_of(p[:, real]) - np.eye(int(real.sum()))).max(initial=0.0)) if real.any() else 0.0

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                ids, xs = b.column(0).slice(lo, 1024), b.column(1).slice(lo, 1024)
                x = xs.flatten().to_numpy(zero_copy_only=False).reshape(len(xs), dim)
                far = n * x - total
                if float(np.abs(far.astype(float)).max(initial=0.0)) ** 2 * dim < 2.0**62:
                    dev = (far * far).sum(axis=1)
                else:
                    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
                    if max(exact) >= 2**63:
                        raise OverflowError("whitening: a deviation does not fit 64 bits")
                    dev = np.array(exact, np.int64)
                white = (far / n) @ p
                m = len(xs)
                cols = [
                    ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(dev, k)), pa.array(white.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return base.mapInArrow(go, out)
