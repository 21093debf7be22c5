"""Operator 12: whitening of embeddings by spectral divide and conquer.

Covariances are taken by Spark: exact integer sums first, then products of centred vectors, added up in
tasks and combined entry by entry, so that a dim by dim matrix is all that reaches the driver.

Its eigenvectors come of polar decompositions alone. The polar factor U of V - s I has the eigenvectors
of V with eigenvalue 1 above the shift s and -1 below it, so (I + U) / 2 projects onto the upper
invariant subspace. QDWH (dynamically weighted Halley steps, each a QR factorisation) finds U in six or
seven steps whatever the condition. A basis of the range and one of its complement split the problem in
two, and each half is split again until single components are left. The components, a matrix of dim by
at most `components`, then go to all tasks, which project their vectors.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.stash import stash

EPS = np.finfo(np.float64).eps
#: Entries beyond this count as this.
MOST = 1 << 52
ROWS = 4096


def qdwh(a: np.ndarray, most_steps: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a square matrix without singular values of zero, by QR-based Halley steps."""
    m = len(a)
    x = a / np.linalg.norm(a)
    low = EPS  # a lower bound of the singular values; a smaller true one only costs a step
    for _ in range(most_steps):
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / (sq * sq))
        wa = math.sqrt(1 + d) + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - sq) / (sq * math.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.concatenate([math.sqrt(wc) * x, np.eye(m)]))
        new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * (q[:m] @ q[m:].T)
        low = min(1.0, low * (wa + wb * sq) / (1 + wc * sq))
        step, x = np.linalg.norm(new - x), new
        if 1 - low < 10 * EPS and step < 1e-5:  # steps are cubic: the next one is below rounding
            break
    return x


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Shifts to try: the median of the diagonal halves well, the mean always lies between two eigenvalues."""
    diagonal = np.diag(a)
    mean, spread = float(diagonal.mean()), float(np.linalg.norm(a - np.eye(len(a)) * diagonal.mean()))
    yield float(np.median(diagonal))
    yield mean
    for k in range(1, 40):
        yield mean + spread * 0.37 ** (k // 2 + 1) * (-1) ** k


def _split(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the upper and the lower invariant subspace of `a`; None if no shift tells any apart."""
    m = len(a)
    eye, start = np.eye(m), np.random.default_rng(7).standard_normal((m, m))
    best, error = None, math.inf
    for shift in _shifts(a):
        moved = a - shift * eye
        if not moved.any():
            continue
        u = qdwh(moved)
        p = (eye + (u + u.T) / 2) / 2
        k = round(float(np.trace(p)))
        if not 0 < k < m:
            continue
        q, _ = np.linalg.qr(p @ start[:, :k], mode="complete")
        q, _ = np.linalg.qr(p @ q[:, :k], mode="complete")
        off = float(np.linalg.norm(q[:, k:].T @ a @ q[:, :k]))
        if off < error:
            best, error = (q[:, :k], q[:, k:]), off
        if off <= 8 * m * EPS * size:
            break
    return best if error <= 1e-10 * size else None


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns."""
    size = float(np.linalg.norm(v))
    values, vectors, open_ = [], [], [(np.eye(len(v)), v)]
    while open_:
        basis, a = open_.pop()
        halves = None
        if len(a) > 1 and np.linalg.norm(a - np.eye(len(a)) * np.trace(a) / len(a)) > EPS * size:
            halves = _split(a, size)
        if halves is None:  # one component, or some of one eigenvalue, for which any basis does
            values += np.diag(a).tolist()
            vectors.append(basis)
            continue
        for half in halves:
            part = half.T @ a @ half
            open_.append((basis @ half, (part + part.T) / 2))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.concatenate(vectors, axis=1)[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fit: number of vectors, exact sums per dimension, and components (as columns) by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); NaN for components without variance, that is none to double precision."""
        some = self.eigenvalues > len(self.sums) * EPS * max(self.eigenvalues[0], 0.0)
        return np.where(some, 1 / np.sqrt(np.where(some, self.eigenvalues, 1.0)), np.nan)

    @property
    def explained(self) -> np.ndarray:
        return np.maximum(self.eigenvalues, 0.0) / self.trace if self.trace > 0 else np.zeros(len(self.eigenvalues))


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows to keep, their lengths, their entries as longs, one after another) of an array of double lists."""
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    entries = np.asarray(flat.fill_null(math.nan))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    ends = np.cumsum(size)
    keep = np.asarray(column.is_valid()) & (size > 0) & (bad[ends] == bad[ends - size])
    good = entries[np.repeat(keep, size)]
    scaled = np.clip(np.floor(np.clip(good, -MOST, MOST) * 64), -MOST, MOST)
    return keep, size[keep], scaled.astype(np.int64) + 1_000_000


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, x) of the usable rows: x is floor(64 c) + 1000000 of every entry c, as little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep, size, x = _whole(batch.column(1))
            data, ends = x.astype("<i8").tobytes(), (np.cumsum(size) * 8).tolist()
            cut = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), pa.array(size, pa.int32()), pa.array(cut, pa.binary())], names=["vec_id", "dim", "x"])

    one = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    return one.mapInArrow(run, "vec_id long, dim int, x binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _sums(vectors: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and their exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            for part in _blocks(batch):
                x = _matrix(part.column(0), dim)
                n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = vectors.select("x").mapInArrow(run, "i int, n long, high long, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = {r.i: r for r in parts.groupBy("i").agg(F.sum("n").alias("n"), exact("high").alias("high"), exact("low").alias("low")).collect()}  # a row a dimension
    return found[0].n, tuple((int(found[i].high) << 26) + int(found[i].low) for i in range(dim))


def _differences(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S, exact: longs where they fit with room for the sum of their squares, else Python's integers."""
    if len(x):
        most = max(max(abs(n * int(a)), abs(n * int(b)), abs(n * int(a) - s), abs(n * int(b) - s), abs(s)) for a, b, s in zip(x.min(0), x.max(0), sums, strict=True))
        if most >= 1 << 62:
            return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def _squares(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows; null past 38 digits."""
    most = int(max(abs(d.min()), abs(d.max()))) if d.size else 0
    if most * most * d.shape[1] >= 1 << 63:
        d = d.astype(object)
    return [s if s < 10**38 else None for s in map(int, (d * d).sum(1))]


def _moments(vectors: DataFrame, n: int, sums: tuple[int, ...], project: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The covariance (divisor n) of what `project` makes of centred vectors; their mean is zero by construction."""
    dim = len(sums)
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((width, width)), False
        for batch in batches:
            for part in _blocks(batch):
                y = project(_differences(_matrix(part.column(0), dim), n, sums).astype(np.float64) / n)
                total, some = total + y.T @ y, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], names=["i", "j", "v"])

    parts = vectors.select("x").mapInArrow(run, "i int, j int, v double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a row an entry of the matrix
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def fit_whitening(vectors: DataFrame, dim: int) -> Whitening:
    """Fits all rows of `integer_vectors` that have `dim` entries; there must be one."""
    n, sums = _sums(vectors, dim)
    v = _moments(vectors, n, sums, lambda d: d, dim)
    values, basis = spectral_components(v)
    return Whitening(n, sums, values, basis, float(np.trace(v)))


def project(vectors: DataFrame, fit: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, whitened) of the vectors: whitened is an array of doubles, null for components without variance."""
    dim = len(fit.sums)
    matrix = fit.vectors[:, :components] * fit.scale[:components]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _blocks(batch):
                d = _differences(_matrix(part.column(1), dim), fit.n, fit.sums)
                y = (d.astype(np.float64) / fit.n) @ matrix
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.reshape(-1), from_pandas=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pa.array(_squares(d), pa.decimal128(38, 0)), pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(vectors: DataFrame, fit: Whitening, components: int) -> float:
    """The largest entry of (covariance of the whitened vectors - identity), over components with variance."""
    keep = ~np.isnan(fit.scale[:components])
    matrix = (fit.vectors[:, :components] * fit.scale[:components])[:, keep]
    width = matrix.shape[1]
    return float(np.abs(_moments(vectors, fit.n, fit.sums, lambda d: d @ matrix, width) - np.eye(width)).max()) if width else 0.0


def whiten_embeddings(df: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row a usable vector and component.

    Rows of `df` (`vec_id`, `embedding`) whose vector is null, empty or holds null or non-finite entries
    are dropped. Entries c count as x = floor(64 c) + 1000000; those beyond 2 ** 52 in size count as that. Vectors
    of another length are fitted by themselves. Components without variance (to double precision; all of them if
    vectors are equal) have `whitened` null and are left out of `identity_error`, which is 0 if there are
    no others. `deviation` is null past 38 digits. Repeated rows and ids are vectors of their own; a null
    vec_id stays null. An empty table gives no rows; extra columns are ignored.
    """
    all_ = stash(integer_vectors(df), "integer-vectors")
    out = None
    for row in all_.select("dim").distinct().collect():  # a row a length of vector
        vectors = all_.where(F.col("dim") == row.dim)
        fit = fit_whitening(vectors, row.dim)
        k = min(components, row.dim)
        fixed = F.array(*(F.lit(float(e)) for e in fit.explained[:k]))
        error = identity_error(vectors, fit, k)
        one = project(vectors, fit, k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        one = one.select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
            fixed[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        return all_.select("vec_id", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")))
    return out
