"""Embedding whitening: principal components of a distributed covariance, scaled to unit variance.

Two passes over the vectors build the fit: exact sums per dimension, then the
covariance of the centred vectors, each task adding up its own matrix and the
matrices meeting row by row in a shuffle. The matrix (its size depends on the
dimension alone, never on the rows) goes to the driver, which makes it
tridiagonal by Householder reflections, finds the leading eigenvalues by
bisection on Sturm counts and their vectors by inverse iteration, where close
eigenvalues are kept orthogonal to each other. A third pass projects every
vector on the broadcast components.

Defined results
* Rows whose vector is null or holds null or non-finite entries are dropped.
* Vectors of each length are a population of their own, with their own fit; an
  empty vector has no component and gives no row. Fewer dimensions than the
  asked components give as many components as there are dimensions.
* Repeated rows and repeated or null ids count and return one by one.
* Entries are cut to whole numbers: ``floor(scale * entry) + shift``; what a
  64-bit integer can't hold goes to its nearest end.
* ``deviation`` is null where it has over 38 digits.
* A component without variance beyond rounding (one vector, equal vectors,
  fewer independent dimensions than components) has null ``whitened``, zero
  ``explained``, and does not enter ``identity_error``, which is 0 where no
  component has variance.
* An empty table gives an empty result. Only the id and the vector are read, so
  further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import staged

EPS = np.finfo(np.float64).eps

#: Vectors that a task multiplies at a time: 2,048 of 4,096 dimensions take 64 MB.
BLOCK = 2_048

#: Largest magnitude of a cut entry before the shift.
LONGEST = float(2 ** 63 - 2 ** 20)


# -- eigenvalues and vectors of a symmetric matrix, on the driver ------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal, off-diagonal and the Householder reflections (v, beta) that lead to them."""
    a = np.array(matrix, dtype=np.float64)
    n, steps = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        top = np.abs(x).max()
        if np.abs(x[1:]).max() == 0:
            steps.append((x, 0.0))
            continue
        v = x / top
        length = np.sqrt(v @ v)
        head = -np.copysign(length, v[0])
        v[0] -= head
        beta = 2.0 / (v @ v)
        sub = a[k + 1:, k + 1:]
        p = beta * (sub @ v)
        w = p - (0.5 * beta * (p @ v)) * v
        sub -= np.outer(v, w)
        sub -= np.outer(w, v)
        a[k + 1:, k] = 0.0
        a[k + 1, k] = head * top
        a[k, k + 1:] = a[k + 1:, k]
        steps.append((v, beta))
    return np.diag(a).copy(), np.diag(a, -1).copy(), steps


def reflected_back(steps: list[tuple[np.ndarray, float]], vectors: np.ndarray) -> np.ndarray:
    """Vectors of the tridiagonal matrix (columns) as vectors of the full one."""
    z = vectors.copy()
    for k in range(len(steps) - 1, -1, -1):
        v, beta = steps[k]
        if beta:
            z[k + 1:] -= beta * np.outer(v, v @ z[k + 1:])
    return z


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative pivots of T - at * I."""
    scale = max(np.abs(diag).max(), np.abs(off).max() if len(off) else 0.0, 1e-300)
    least = EPS * EPS * scale
    q = diag[0] - at
    below = (q < 0).astype(np.int64)
    for i in range(1, len(diag)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diag[i] - at - off[i - 1] * (off[i - 1] / q)
        below += q < 0
    return below


def leading_eigenvalues(diag: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, largest first, bisected until the interval can't be halved."""
    n = len(diag)
    wide = np.zeros(n)
    wide[:-1] += np.abs(off)
    wide[1:] += np.abs(off)
    low, high = (diag - wide).min(), (diag + wide).max()
    norm = max(abs(low), abs(high), 1e-300)
    room = EPS * norm * n
    lo, hi = np.full(count, low - room), np.full(count, high + room)
    rank = n - 1 - np.arange(count)  # so many eigenvalues lie below the wanted one
    while True:
        mid = 0.5 * (lo + hi)
        open_ = (mid > lo) & (mid < hi) & (hi - lo > EPS * EPS * norm)
        if not open_.any():
            return mid
        under = sturm_counts(diag, off, mid) > rank
        hi = np.where(open_ & under, mid, hi)
        lo = np.where(open_ & ~under, mid, lo)


def solved(diag: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift * I) x = right by elimination with row exchanges; pivots of zero become ``least``."""
    n = len(diag)
    d, b = (diag - shift).tolist(), right.tolist()
    up, up2, low = [*off.tolist(), 0.0], [0.0] * n, off.tolist()
    for i in range(n - 1):
        if abs(d[i]) >= abs(low[i]):
            if abs(d[i]) < least:
                d[i] = least
            f = low[i] / d[i]
            d[i + 1] -= f * up[i]
            b[i + 1] -= f * b[i]
        else:  # the next row is the better pivot
            f = d[i] / low[i]
            d[i], d[i + 1], up[i], up2[i] = low[i], up[i] - f * d[i + 1], d[i + 1], up[i + 1]
            up[i + 1] = -f * up2[i]
            b[i], b[i + 1] = b[i + 1], b[i] - f * b[i + 1]
    if abs(d[-1]) < least:
        d[-1] = least
    x = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - up[i] * x[i + 1] - up2[i] * x[i + 2]) / d[i]
        if abs(x[i]) > 1e250:  # only the direction counts
            x = [y * 1e-250 for y in x]
            b = [y * 1e-250 for y in b]
    return np.array(x[:n])


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix at ``values``, which fall.

    Values nearer to each other than a thousandth of the norm form a cluster;
    every iterate is made orthogonal to the vectors its cluster already has.
    """
    n = len(diag)
    norm = max(np.abs(diag).max() + 2 * (np.abs(off).max() if len(off) else 0.0), 1e-300)
    rng, out, first, shift = np.random.default_rng(11), np.zeros((n, len(values))), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first, shift = j, np.inf
        shift = min(value, shift - 10 * EPS * norm)  # equal values get shifts that differ
        x = rng.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
            y = solved(diag, off, shift, x, EPS * norm)
            y /= np.linalg.norm(y)
            for _ in range(2):
                y -= out[:, first:j] @ (out[:, first:j].T @ y)
            size = np.linalg.norm(y)
            if size < 1e-8:  # nothing left beside the cluster: start from elsewhere
                x = rng.standard_normal(n)
                continue
            y /= size
            still = min(np.abs(y - x).max(), np.abs(y + x).max())
            x = y
            if still < 4 * EPS:
                break
        out[:, j] = x
    return out


def leading_eigen(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues and unit eigenvectors (columns) of a symmetric matrix.

    The sign of a vector is set by its entry of largest magnitude, so that runs agree.
    """
    n, scale = len(matrix), np.abs(matrix).max() if len(matrix) else 0.0
    count = min(count, n)
    if scale == 0:
        return np.zeros(count), np.eye(n)[:, :count]
    diag, off, steps = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diag, off, count)
    vectors = reflected_back(steps, inverse_iteration(diag, off, values))
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(count)]
    return values * scale, vectors * np.where(top < 0, -1.0, 1.0)


# -- vectors of an Arrow batch -----------------------------------------------------------------------------------

def _blocks(batch: pa.RecordBatch, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, cut vectors) of the batch's valid rows, by length and at most BLOCK at a time."""
    col = batch.column("vec")
    length = col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = col.flatten().to_numpy(zero_copy_only=False)  # a null entry reads as NaN
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    for size in np.unique(length[length > 0]):
        for rows in np.split(at := np.flatnonzero(length == size), range(BLOCK, len(at), BLOCK)):
            x = flat[start[rows][:, None] + np.arange(size)].astype(np.float64)
            good = np.isfinite(x).all(axis=1)
            if good.any():
                with np.errstate(over="ignore"):
                    cut = np.clip(np.floor(scale * x[good]), -LONGEST, LONGEST)
                yield rows[good], cut.astype(np.int64) + shift


def _sums(scale: int, shift: int):
    """Per task, length and dimension: rows, and the exact sum in two halves of 32 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in _blocks(batch, scale, shift):
                t = total.setdefault(x.shape[1], [0, 0, 0])
                t[0] += len(x)
                t[1] = t[1] + (x >> 32).sum(axis=0)
                t[2] = t[2] + (x & 0xFFFFFFFF).sum(axis=0)
        for size, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, size), pa.int32()), pa.array(np.arange(size), pa.int32()),
                 pa.array(np.full(size, n)), pa.array(high), pa.array(low)], ["dim", "place", "n", "high", "low"])
    return run


class Center:
    """The mean as a whole part m and a rest r / n, so that differences to it lose nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = [s // n for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, self.whole, strict=True)]
        self.m = np.array(self.whole, dtype=np.int64)
        self.share = np.array([r / n for r in self.rest])
        self.rest_square = sum(r * r for r in self.rest)

    def whole_differences(self, x: np.ndarray) -> np.ndarray:
        """x - m: exact integers, or rounded where 64 bits don't hold them."""
        with np.errstate(over="ignore"):
            d = x - self.m
        wrong = ((x ^ self.m) & (x ^ d)) < 0
        return np.where(wrong, x.astype(np.float64) - self.m.astype(np.float64), d) if wrong.any() else d

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.whole_differences(x).astype(np.float64) - self.share

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2 of each row, exact: with d = x - m, (n * d - r)^2 term by term."""
        d = self.whole_differences(x)
        if d.dtype == np.int64 and d.shape[1] * (most := int(np.abs(d).max())) * max(most, self.n) < 2 ** 62:
            square, cross = (d * d).sum(axis=1).tolist(), (d @ np.array(self.rest, dtype=np.int64)).tolist()
            n2 = self.n * self.n
            return [n2 * a - 2 * self.n * b + self.rest_square for a, b in zip(square, cross, strict=True)]
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def _scatter(scale: int, shift: int, centers):
    """Per task and length: the rows of the upper half of the sum of outer products of centred vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), {}
        for batch in batches:
            for _, x in _blocks(batch, scale, shift):
                c = centers.value[x.shape[1]].centred(x)
                if x.shape[1] not in total:
                    total[x.shape[1]] = np.zeros((x.shape[1], x.shape[1]))
                total[x.shape[1]] += c.T @ c
        for size, s in total.items():
            for i in range(size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size], pa.int32()), pa.array([i], pa.int32()), pa.array([part], pa.int32()),
                     pa.array([s[i, i:]], pa.list_(pa.float64()))], ["dim", "row", "part", "sums"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrix rows of one (dim, row), which arrive next to each other, added up."""
    def done(at, total):
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()),
                                           pa.array([total], pa.list_(pa.float64()))], ["dim", "row", "sums"])
    at, total = None, None
    for batch in batches:
        sums = batch.column("sums")
        for k, key in enumerate(zip(batch.column("dim").to_pylist(), batch.column("row").to_pylist(), strict=True)):
            row = sums[k].values.to_numpy()
            if key == at:
                total = total + row
            else:
                if at:
                    yield done(at, total)
                at, total = key, row
    if at:
        yield done(at, total)


# -- the operator ------------------------------------------------------------------------------------------------

class Fit:
    """Center, leading eigenvalues and vectors of the vectors of one length."""

    def __init__(self, center: Center, covariance: np.ndarray, components: int):
        self.center, self.trace = center, float(np.trace(covariance))
        self.values, self.vectors = leading_eigen(covariance, components)
        self.live = self.values > EPS * len(covariance) * max(self.trace, 0.0)
        with np.errstate(divide="ignore"):
            self.scaled = np.where(self.live, self.vectors / np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)
        self.explained = [float(e / self.trace) if ok else 0.0 for e, ok in zip(self.values, self.live, strict=True)]


def fit(vectors: DataFrame, vec_col: str, components: int, scale: int, shift: int) -> dict[int, Fit]:
    """A fit for each length of vector. Exact sums and the matrix rows reach the driver, nothing by row."""
    spark = vectors.sparkSession
    vec = vectors.select(F.col(vec_col).cast("array<double>").alias("vec"))
    # a task's matrix has dim^2 entries whatever it reads, so a task reads several splits where there are many
    vec = vec.coalesce(max(1, 4 * spark.sparkContext.defaultParallelism))
    sums = vec.mapInArrow(_sums(scale, shift), "dim int, place int, n long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found: dict[int, dict[int, tuple]] = {}
    for r in sums.groupBy("dim", "place").agg(F.sum("n").alias("n"), wide("high"), wide("low")).collect():
        found.setdefault(r["dim"], {})[r["place"]] = (r["n"], (int(r["high"]) << 32) + int(r["low"]))
    centers = {d: Center(at[0][0], [at[i][1] for i in range(d)]) for d, at in found.items()}
    if not centers:
        return {}
    rows = vec.mapInArrow(_scatter(scale, shift, spark.sparkContext.broadcast(centers)),
                          "dim int, row int, part int, sums array<double>")
    rows = (rows.repartition("dim", "row").sortWithinPartitions("dim", "row", "part")
            .mapInArrow(_added, "dim int, row int, sums array<double>"))
    whole = {d: np.zeros((d, d)) for d in centers}
    table = rows.toArrow()
    for d, i, sums in zip(*(table.column(c).to_pylist() for c in ("dim", "row")), table.column("sums"), strict=True):
        whole[d][i, i:] = sums.values.to_numpy()
    out = {}
    for d, half in whole.items():
        covariance = (half + np.triu(half, 1).T) / centers[d].n
        out[d] = Fit(centers[d], covariance, components)
    return out


def _project(scale: int, shift: int, fits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _blocks(batch, scale, shift):
                f = fits.value[x.shape[1]]
                white = f.center.centred(x) @ f.scaled
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows)), pa.array(np.full(len(rows), x.shape[1]), pa.int32()),
                     pa.array([str(v) for v in f.center.deviations(x)]),
                     pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1], white.ravel())],
                    ["id", "dim", "deviation", "white"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8,
           scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """id, dim, component, n, deviation (decimal), whitened, explained, identity_error of every vector and component.

    ``identity_error`` is measured on the whitened values themselves: the
    largest absolute entry of their covariance (divisor n) minus the identity.
    """
    spark = vectors.sparkSession
    fits = fit(vectors, vec_col, components, scale, shift)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.mapInArrow(_project(scale, shift, spark.sparkContext.broadcast(fits)),
                           f"id {kind}, dim int, deviation string, white array<double>")
    rows = staged(rows, "whitened")  # an eighth of a 64-dimensional input; measured, then returned
    out = None
    for dim, f in fits.items():
        one, live = rows.where(F.col("dim") == dim), np.flatnonzero(f.live).tolist()
        pairs = [(i, j) for i in live for j in live if i <= j]
        error = 0.0
        if pairs:
            covariance = one.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c{i}_{j}")
                                   for i, j in pairs]).first()
            error = max(abs(v - (i == j)) for v, (i, j) in zip(covariance, pairs, strict=True))
        explained = F.array(*[F.lit(e) for e in f.explained])
        one = one.select("id", "dim", F.posexplode("white").alias("at", "value"),
                         F.lit(f.center.n).cast("long").alias("n"),
                         F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
                         explained.alias("shares"), F.lit(float(error)).alias("identity_error"))
        one = one.select(F.col("id").alias(id_col), "dim", (F.col("at") + 1).cast("int").alias("component"), "n",
                         "deviation", F.when(~F.isnan("value"), F.col("value")).alias("whitened"),
                         F.element_at("shares", F.col("at") + 1).alias("explained"), "identity_error")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], f"`{id_col}` {kind}, dim int, component int, n long, deviation decimal(38,0), "
                                        "whitened double, explained double, identity_error double")
    return out
