"""Whitening of embeddings by their leading principal components.

Spark sums the vectors and then the products of centred vectors; only matrices of the vectors' length reach the
driver. There the covariance is made tridiagonal by Householder reflections, its leading eigenvalues are bisected
by Sturm counts, and inverse iteration gives the components, orthogonalised within clusters of close eigenvalues.
The components are small and go out to all tasks, which project their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import matrices, sum_arrays

#: Rule that makes a long of an entry: floor(SCALE * c) + SHIFT. Entries that leave no long are treated as infinite.
SCALE, SHIFT, LARGEST = 1024.0, 100_000, 2.0**62
#: Longest vectors: their covariance takes 8 * MAX_DIMS ** 2 bytes on the driver.
MAX_DIMS = 4096
#: Eigenvalues closer than this part of the norm share a cluster, whose vectors are orthogonalised.
CLUSTER = 1e-3
_LOW = (1 << 31) - 1


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and Householder vectors of a symmetric matrix."""
    a = np.array(v, float)
    reflectors = []
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        long = float(np.linalg.norm(u))
        if long > 0:
            u[0] += np.copysign(long, u[0])
            u /= np.linalg.norm(u)
            block = a[k + 1 :, k + 1 :]
            p = block @ u
            w = 2 * (p - (u @ p) * u)
            block -= np.outer(u, w) + np.outer(w, u)
            a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_counts(diag: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each value of ``at``."""
    tiny = np.finfo(float).tiny
    least = max(tiny, float((side**2).max(initial=0.0)) * tiny)
    q = diag[0] - at
    below = (q < 0).astype(np.int64)
    for d, e in zip(diag[1:], side, strict=True):
        q = d - at - e * e / np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_eigenvalues(diag: np.ndarray, side: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected until no double lies between its bounds."""
    n = len(diag)
    count = min(count, n)
    reach = np.append(np.abs(side), 0) + np.append(0, np.abs(side))
    lo, hi = np.full(count, (diag - reach).min()), np.full(count, (diag + reach).max())
    pad = 1e-12 * max(np.abs(lo[0]), np.abs(hi[0]), np.finfo(float).tiny)
    lo, hi, rank = lo - pad, hi + pad, n - 1 - np.arange(count)
    while True:
        mid = lo + (hi - lo) / 2
        if not ((mid > lo) & (mid < hi)).any():
            return mid
        below = sturm_counts(diag, side, mid) > rank
        hi, lo = np.where(below, mid, hi), np.where(below, lo, mid)


def _solve(diag: np.ndarray, side: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) z = b by elimination with row exchanges; a vanishing pivot becomes ``least``."""
    n, z = len(diag), b.tolist()
    d, e = (diag - shift).tolist(), [*side.tolist(), 0.0]
    rows, now, up = [], d[0], e[0]
    for i in range(n - 1):
        if abs(e[i]) > abs(now):
            rows.append((e[i], d[i + 1], e[i + 1]))
            z[i], z[i + 1], f = z[i + 1], z[i], now / e[i]
            now, up = up - f * d[i + 1], -f * e[i + 1]
        else:
            now = now if abs(now) > least else least
            rows.append((now, up, 0.0))
            f = e[i] / now
            now, up = d[i + 1] - f * up, e[i + 1]
        z[i + 1] -= f * z[i]
    rows.append((now if abs(now) > least else least, 0.0, 0.0))
    z += [0.0, 0.0]
    for i in range(n - 1, -1, -1):
        pivot, one, two = rows[i]
        z[i] = (z[i] - one * z[i + 1] - two * z[i + 2]) / pivot
    return np.array(z[:n])


def components_of(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive."""
    if not np.any(v):
        return np.zeros(min(count, len(v))), np.eye(len(v))[:, :count]
    diag, side, reflectors = tridiagonal(v)
    values = leading_eigenvalues(diag, side, count)
    norm = max(float(np.abs(values).max(initial=0.0)), float(np.abs(diag).max(initial=0.0)), np.finfo(float).tiny)
    least = np.finfo(float).eps * norm
    rng = np.random.default_rng(11)
    found: list[np.ndarray] = []
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        z = rng.normal(size=len(diag))
        for _ in range(4):
            z = _solve(diag, side, float(value), z / np.linalg.norm(z), least)
            z /= np.abs(z).max()
            for _ in range(2):
                for w in found[first:]:
                    z -= (w @ z) * w
        found.append(z / np.linalg.norm(z))
    vectors = np.array(found).T
    for k in range(len(reflectors) - 1, -1, -1):
        u = reflectors[k]
        vectors[k + 1 :] -= 2 * np.outer(u, u @ vectors[k + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])


def as_longs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of doubles become longs, and those longs."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * c)
    ok = (np.abs(x) < LARGEST).all(1)
    return ok, x[ok].astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Fit:
    """What the vectors of one length leave: their number, exact sums, components, eigenvalues and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n without loss: the whole part of the mean goes in longs, its fraction in doubles."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)^2, exact at any size."""
        sums = np.array(self.sums, object)
        far = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in self.sums)
        if far * far * x.shape[1] < 1 << 63:
            d = self.n * x - sums.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * x.astype(object) - sums
        return (d * d).sum(1).tolist()

    def scales(self) -> np.ndarray:
        """1/sqrt(e), undefined where the components' variance is nothing but rounding."""
        least = len(self.sums) * np.finfo(float).eps * self.trace
        return np.where(self.values > least, 1 / np.sqrt(np.maximum(self.values, np.finfo(float).tiny)), np.nan)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors * self.scales()


def _longs(batches, column: int, dims: int | None = None):
    """(batch, row numbers, longs) of the usable vectors."""
    for batch in batches:
        for rows, c in matrices(batch.column(column)):
            if c.shape[1] and dims in (None, c.shape[1]):
                ok, x = as_longs(c)
                if len(x):
                    yield batch, rows[ok], x


def fit(vectors: DataFrame, components: int = 8, vector_col: str = "embedding") -> Fit | None:
    """Components of the vectors of the commonest length (of several the longest); None without any vector.

    Rows whose vector is null or empty, or holds a null, infinite or undefined entry, take no part.
    """
    only = vectors.select(F.col(vector_col).alias("v"))
    partial = T.StructType([T.StructField("dims", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("high", "low")]])

    def count(batches):
        held: dict[int, list] = {}
        for _, rows, x in _longs(batches, 0):
            now = held.setdefault(x.shape[1], [0, 0, 0])
            for k, more in enumerate((len(rows), (x >> 31).sum(0), (x & _LOW).sum(0))):
                now[k] = now[k] + more
        for dims, (n, high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int64()), pa.array([n], pa.int64()), *[pa.array([z], pa.list_(pa.int64())) for z in (high, low)]], names=partial.names)

    counted = only.mapInArrow(count, partial)
    most = counted.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    dims, n = most["dims"], most["n"]
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries: the covariance on the driver is bounded by {MAX_DIMS}")
    each = counted.where(F.col("dims") == dims).select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    rows = each.groupBy("i").agg(F.sum("s.high").alias("high"), F.sum("s.low").alias("low")).orderBy("i").collect()
    sums = tuple((r["high"] << 31) + r["low"] for r in rows)
    empty = Fit(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    products = T.StructType([T.StructField("key", T.LongType()), T.StructField("task", T.LongType()), T.StructField("value", T.ArrayType(T.DoubleType()))])

    def multiply(batches):
        total = np.zeros((dims, dims))
        some = False
        for _, _, x in _longs(batches, 0, dims):
            c = empty.centred(x)
            total += c.T @ c
            some = True
        if some:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, task)), pa.array(list(total), pa.list_(pa.float64()))], names=products.names)

    covariance = np.zeros((dims, dims))
    for r in sum_arrays(only.mapInArrow(multiply, products)).toLocalIterator():
        covariance[r["key"]] = r["total"]
    covariance = (covariance + covariance.T) / (2 * n)
    values, axes = components_of(covariance, components)
    return Fit(n, sums, values, axes, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, fitted: Fit, vector_col: str = "embedding") -> float | None:
    """Largest entry of the whitened rows' own covariance less the identity, over components with variance.

    Every task sums around the mean of its rows; counts, means and sums of two tasks merge into those of both.
    """
    k = len(fitted.values)
    schema = T.StructType([T.StructField("task", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mean", "m2")]])

    def merge(a, b):
        n = a[0] + b[0]
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def spread(batches):
        held = None
        for _, _, x in _longs(batches, 0, len(fitted.sums)):
            w = fitted.whitened(x)
            c = w - w.mean(0)
            own = (len(w), w.mean(0), c.T @ c)
            held = own if held is None else merge(held, own)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.list_(pa.float64())), pa.array([held[2].ravel()], pa.list_(pa.float64()))], names=schema.names)

    held = None
    for r in vectors.select(F.col(vector_col).alias("v")).mapInArrow(spread, schema).orderBy("task").toLocalIterator():
        own = (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(k, k))
        held = own if held is None else merge(held, own)
    some = np.isfinite(fitted.scales())
    if held is None or not some.any():
        return None
    return float(np.abs((held[2] / held[0] - np.eye(k))[np.ix_(some, some)]).max())


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    Usable is a row whose vector has the commonest length and neither null, infinite nor undefined entries, nor
    ones whose scaled value is no long; other rows are left out, as are empty vectors. Vectors of fewer entries
    than ``components`` have as many components as entries. A component without variance has a null ``whitened``;
    ``explained`` is null if nothing varies, and so is ``identity_error``. A ``deviation`` beyond a long is null in
    that column and whole in ``deviation_text``. Rows that repeat stand for themselves; a null id stays null. An empty
    table gives no rows.
    """
    schema = T.StructType(
        [T.StructField(id_col, T.LongType()), T.StructField("component", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("n", "deviation")], *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")], T.StructField("deviation_text", T.StringType())]
    )
    fitted = fit(vectors, components, vector_col)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, fitted, vector_col)
    k = len(fitted.values)
    explained = [float(e / fitted.trace) if fitted.trace > 0 else None for e in np.maximum(fitted.values, 0)]

    def project(batches):
        for batch, rows, x in _longs(batches, 1, len(fitted.sums)):
            w = fitted.whitened(x).ravel()
            far = fitted.deviations(x)
            each = np.repeat(rows, k)
            deviation = [d if d < 1 << 63 else None for d in far for _ in range(k)]
            columns = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), fitted.n)), pa.array(deviation, pa.int64()), pa.array(w, mask=~np.isfinite(w)), pa.array(explained * len(x), pa.float64()), pa.array([error] * len(each), pa.float64()), pa.array([str(d) for d in far for _ in range(k)])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).alias("v")).mapInArrow(project, schema)
