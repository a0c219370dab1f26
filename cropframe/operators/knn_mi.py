"""Nearest-neighbour mutual information of numeric columns with a target (M1).

The estimator of Kraskov et al. (first algorithm): with r the distance of a row
to its k-th nearest other row under the maximum norm in (x, y), and nx, ny the
other rows nearer than r in x and in y alone (at r = 0: equal),

    MI = psi(n) + psi(k) - mean(psi(nx + 1) + psi(ny + 1)),  at least 0.

All features go through the same jobs:

* Values are shifted to their minimum, divided by their standard deviation
  (ten digits of it) and cut to whole numbers of 2^-30; distances are then exact
  and ties have one meaning everywhere. Equal rows are counted, not repeated, so
  a value holding a third of the rows is one point.
* Points are dealt to cells of a grid: strips of x with about equally many
  points, each cut along y by the strip's own points. The edges come from a
  hashed sample of ``sample`` points a feature (the sample only shapes the cells;
  every point is placed and searched). A first round finds each point's
  k nearest in its own cell, which bounds r; a second one asks only the cells
  that the box of that bound reaches. Together they are exact.
* nx and ny are differences of running counts over the distinct values.

Work per point is a cell's size times the few cells its box meets; nothing is
paired with all others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEIGHBORS = 3
CELL_POINTS = 512
SAMPLE = 1 << 17
FINE = float(1 << 30)
FAR = np.iinfo(np.int64).max
EULER = 0.57721566490153286061


def digamma(n: Column) -> Column:
    """psi of whole numbers from 1: a table below 16, the asymptotic series above (to 1e-12)."""
    table = [-EULER + sum(1.0 / i for i in range(1, m)) for m in range(1, 16)]
    x = n.cast("double")
    inv = 1.0 / (x * x)
    series = F.log(x) - 0.5 / x - inv / 12.0 + inv * inv / 120.0 - inv * inv * inv / 252.0
    return F.when(n < 16, F.element_at(F.array(*[F.lit(v) for v in table]), n.cast("int"))).otherwise(series)


class Grid:
    """Cells of one feature's points: strips of x, each with its own cuts along y."""

    def __init__(self, x: np.ndarray, y: np.ndarray, c: np.ndarray, cells: int):
        self.x, self.y, self.c = x, y, c
        strips = max(1, math.isqrt(cells))
        self.edges = np.unique(np.sort(x)[(np.arange(1, strips) * len(x)) // strips]) if len(x) else np.zeros(0, np.int64)
        strip = np.searchsorted(self.edges, x)
        self.cuts = []
        for s in range(len(self.edges) + 1):
            own = np.sort(y[strip == s])
            parts = max(1, round(cells * len(own) / max(1, len(x))))
            self.cuts.append(np.unique(own[(np.arange(1, parts) * len(own)) // parts]) if len(own) else own)
        self.first = np.cumsum([0] + [len(k) + 1 for k in self.cuts])[:-1]

    def cell(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.edges, x)
        return self._in_strips(strip, y)

    def _in_strips(self, strip: np.ndarray, y: np.ndarray) -> np.ndarray:
        out, order = np.empty(len(y), dtype=np.int64), np.argsort(strip, kind="stable")
        if not len(y):
            return out
        at = np.flatnonzero(np.diff(strip[order], prepend=-1))
        for lo, hi in zip(at, [*at[1:], len(order)], strict=True):
            rows = order[lo:hi]
            s = strip[rows[0]]
            out[rows] = self.first[s] + np.searchsorted(self.cuts[s], y[rows])
        return out

    def reached(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row number, cell) of every cell that a row's box of radius r meets, its own left out."""
        a, b = np.searchsorted(self.edges, x - r), np.searchsorted(self.edges, x + r)
        rows, strip = _ranges(a, b)
        low, high = self._in_strips(strip, (y - r)[rows]), self._in_strips(strip, (y + r)[rows])
        again, cell = _ranges(low, high)
        rows = rows[again]
        other = cell != self.cell(x, y)[rows]
        return rows[other], cell[other]

    def bound(self, x: int, y: int, c: int, k: int) -> int:
        """An upper bound of a point's k-th distance, from the sample."""
        d = np.maximum(np.abs(self.x - x), np.abs(self.y - y))
        others = d > 0
        return kth(np.r_[0, d[others]][None, :], np.r_[c, self.c[others]], k)[0][0]


def _ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and every whole number from a to b of each row."""
    size = b - a + 1
    rows = np.repeat(np.arange(len(a)), size)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size) + a[rows]


def kth(d: np.ndarray, c: np.ndarray, k: int, own: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of distances to points that stand for c rows: the k-th one and the k nearest, FAR where there are fewer.

    With ``own``, one row at distance 0 is the asking row itself.
    """
    need = k + own
    near = min(need, d.shape[1])
    at = np.argpartition(d, near - 1, axis=1)[:, :near] if near < d.shape[1] else np.tile(np.arange(near), (len(d), 1))
    dist = np.take_along_axis(d, at, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")
    dist, many = np.take_along_axis(dist, order, axis=1), c[np.take_along_axis(at, order, axis=1)]
    upto = np.cumsum(np.minimum(many, need), axis=1)
    out = np.full((len(d), need), FAR)
    for i in range(need):
        enough = upto > i
        has = enough.any(axis=1)
        out[has, i] = dist[has, enough[has].argmax(axis=1)]
    out = out[:, own:]
    return out[:, -1], out


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[np.ndarray], bool]]:
    """(feature and cell, columns, whether the cell goes on) of rows that come sorted by feature and cell."""
    for batch in batches:
        f = batch.column("feature").to_numpy(zero_copy_only=False)
        cell = batch.column("cell").to_numpy()
        at = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (f[1:] != f[:-1])]) if len(f) else []
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        for lo, hi in zip(at, [*at[1:], len(f)], strict=True):
            yield (f[lo], int(cell[lo])), [v[lo:hi] for v in cols]


def _rows(feature: str, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    arrays = [pa.array([feature] * n)]
    arrays += [pa.array(list(v), pa.list_(pa.int64())) if np.ndim(v) == 2 else pa.array(v, pa.int64()) for v in cols.values()]
    return pa.RecordBatch.from_arrays(arrays, ["feature", *cols])


def _blocks(x, y, px, py, most: int = 1 << 21):
    """Row ranges and distances of points (x, y) to points (px, py), a bounded block at a time."""
    step = max(1, most // max(1, len(px)))
    for lo in range(0, len(x), step):
        hi = min(len(x), lo + step)
        yield lo, hi, np.maximum(np.abs(x[lo:hi, None] - px), np.abs(y[lo:hi, None] - py))


def _place(grids):
    def run(batches):
        for batch in batches:
            f = batch.column("feature").to_numpy(zero_copy_only=False)
            x, y, c = (batch.column(n).to_numpy() for n in ("x", "y", "c"))
            for name in np.unique(f.astype(str)) if len(f) else []:
                m = f == name
                yield _rows(name, cell=grids.value[name].cell(x[m], y[m]), x=x[m], y=y[m], c=c[m])
    return run


def _own_cell(grids, k: int):
    """Round one: the k nearest inside the point's own cell, and a bound of the k-th distance."""
    def done(key, parts):
        x, y, c = (np.concatenate(p) for p in zip(*parts, strict=True))
        for lo, hi, d in _blocks(x, y, x, y):
            r, near = kth(d, c, k)
            for i in np.flatnonzero(r == FAR):
                r[i] = grids.value[key[0]].bound(x[lo + i], y[lo + i], c[lo + i], k)
            yield _rows(key[0], cell=np.full(hi - lo, key[1]), x=x[lo:hi], y=y[lo:hi], c=c[lo:hi], r=r, near=near)

    def run(batches):
        at, parts = None, []
        for key, cols in _groups(batches, ["x", "y", "c"]):
            if key != at:
                if parts:
                    yield from done(at, parts)
                at, parts = key, []
            parts.append(cols)
        if parts:
            yield from done(at, parts)
    return run


def _ask(grids):
    """A row for every other cell that a point's box meets."""
    def run(batches):
        for batch in batches:
            f = batch.column("feature").to_numpy(zero_copy_only=False)
            x, y, c, r = (batch.column(n).to_numpy() for n in ("x", "y", "c", "r"))
            for name in np.unique(f.astype(str)) if len(f) else []:
                for part in np.array_split(np.flatnonzero(f == name), max(1, len(f) // 1024)):
                    rows, cell = grids.value[name].reached(x[part], y[part], r[part])
                    at = part[rows]
                    if len(at):
                        yield _rows(name, cell=cell, x=x[at], y=y[at], c=c[at], r=r[at])
    return run


def _answer(k: int):
    """Round two: of each cell asked, its points within the bound, the k nearest of them."""
    def run(batches):
        at, parts, data = None, [], None
        for key, (kind, x, y, c, r) in _groups(batches, ["kind", "x", "y", "c", "r"]):
            if key != at:
                at, parts, data = key, [], None
            m = kind == 0
            if m.any():
                parts.append((x[m], y[m], c[m]))
            x, y, c, r = x[~m], y[~m], c[~m], r[~m]
            if len(x) and parts:
                data = data or tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                for lo, hi, d in _blocks(x, y, data[0], data[1]):
                    near = kth(d, data[2], k, own=False)[1]
                    near[near > r[lo:hi, None]] = FAR
                    some = near[:, 0] < FAR
                    if some.any():
                        yield _rows(key[0], x=x[lo:hi][some], y=y[lo:hi][some], c=c[lo:hi][some], near=near[some])
    return run


def kth_distances(points: DataFrame, k: int = NEIGHBORS, cell_points: int = CELL_POINTS,
                  sample: int = SAMPLE) -> DataFrame:
    """(feature, x, y, c, r): the exact k-th distance of every point (feature, x, y: long, c: rows).

    Features with at most k rows are left out. ``points`` is read several times.
    """
    from cropframe.operators.model import materialize

    spark = points.sparkSession
    sizes = {r["feature"]: r["m"] for r in points.groupBy("feature").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("m")).collect() if r["n"] > k}     # a row per feature
    if not sizes:
        return points.select("*", F.lit(0).cast("long").alias("r")).limit(0)
    points = points.filter(F.col("feature").isin(list(sizes)))
    share = F.lit(None)
    for f, m in sizes.items():
        share = F.when(F.col("feature") == f, min(1.0, sample / m)).otherwise(share)
    hashed = F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) / float(1 << 30)
    table = points.filter(hashed < share).toArrow()       # about ``sample`` rows a feature
    names, cols = np.array(table.column("feature").to_pylist(), dtype=object), [
        table.column(n).to_numpy() for n in ("x", "y", "c")]
    grids = {}
    for f, m in sizes.items():
        own = [v[names == f] for v in cols]
        grids[f] = Grid(*own, cells=max(1, min(-(-m // cell_points), len(own[0]) // 8)))
    sent = spark.sparkContext.broadcast(grids)
    base = "feature string, cell long, x long, y long, c long"
    cells = points.select("feature", "x", "y", "c").mapInArrow(_place(sent), base)
    first = cells.repartition("feature", "cell").sortWithinPartitions("feature", "cell").mapInArrow(
        _own_cell(sent, k), f"{base}, r long, near array<long>")
    first = materialize(first)
    asks = first.select("feature", "x", "y", "c", "r").mapInArrow(_ask(sent), f"{base}, r long")
    both = first.select("feature", "cell", F.lit(0).cast("long").alias("kind"), "x", "y", "c", "r").unionByName(
        asks.withColumn("kind", F.lit(1).cast("long")))
    second = both.repartition("feature", "cell").sortWithinPartitions("feature", "cell", "kind").mapInArrow(
        _answer(k), "feature string, x long, y long, c long, near array<long>")
    near = first.select("feature", "x", "y", "c", "near").unionByName(second)
    # at most k numbers from each cell that the point's box meets
    every = near.groupBy("feature", "x", "y", "c").agg(F.flatten(F.collect_list("near")).alias("near"))
    return every.select("feature", "x", "y", "c", F.array_sort("near")[k - 1].alias("r"))


def whole_points(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, x, y, c): scaled whole values of every feature with the target, equal rows counted."""
    cols = list(dict.fromkeys([*features, target]))
    ends = df.agg(*[F.min(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()   # two numbers a column

    def whole(c: str) -> Column:
        i = cols.index(c)
        sd = float(f"{ends[f's{i}'] or 0.0:.9e}")
        if not sd:
            return F.when(F.col(c).isNotNull(), F.lit(0).cast("long"))
        return F.floor((F.col(c) - F.lit(ends[f"m{i}"])) / F.lit(sd) * F.lit(FINE)).cast("long")

    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), whole(f).alias("x"), whole(target).alias("y")) for f in features])
    long = df.select(F.explode(pairs).alias("t")).select("t.*").filter("x is not null and y is not null")
    return long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("c"))


def knn_mutual_information(df: DataFrame, features: list[str], target: str, neighbors: int = NEIGHBORS,
                           impute: bool = True, cell_points: int = CELL_POINTS, sample: int = SAMPLE) -> DataFrame:
    """M1 + D5: (feature, relevance) = nearest-neighbour MI with the target, largest first.

    NULL and NaN features get the column's mean (``impute``) or leave the pair
    out; rows without a target are left out. A feature with at most
    ``neighbors`` rows has no relevance (NULL).
    """
    from cropframe.operators.model import materialize
    from cropframe.operators.profile import cumulated
    from cropframe.operators.select import _filled

    k, spark = neighbors, df.sparkSession
    d = materialize(_filled(df, features, target, impute).filter(~F.isnan("_y")).select(
        *[F.nanvl(F.col(f), F.lit(None).cast("double")).alias(f) for f in features], "_y"))
    points = materialize(whole_points(d, features, "_y"))
    far = materialize(kth_distances(points, k, cell_points, sample))
    # other rows nearer than r on one axis: counts up to v + r - 1 less counts up to v - r
    sides = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")),
                              F.struct(F.lit("y").alias("axis"), F.col("y").alias("v")))).alias("s")
    key = F.concat("feature", F.lit("|"), "axis").alias("key")
    asked = far.select("feature", "r", "c", sides).select("feature", "s.*", "r", "c").groupBy(
        "feature", "axis", "v", "r").agg(F.sum("c").alias("w"))
    asked = materialize(asked.select("feature", key, "v", "r", "w"))
    r = F.greatest(F.col("r"), F.lit(1))
    probe = asked.select("*", F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), (2 * (F.col("v") + r - 1) + 1).alias("value")),
        F.struct(F.lit(-1).alias("sign"), (2 * (F.col("v") - r) + 1).alias("value")))).alias("p")).select("*", "p.*").drop("p")
    values = points.select("feature", "c", sides).select("feature", "s.*", "c").select(
        key, (2 * F.col("v")).alias("value"), "c")
    counted = cumulated(values.unionByName(probe.select("key", "value", F.lit(0).cast("long").alias("c"))), "key", "value", "c")
    near = probe.join(counted.select("key", "value", "start"), ["key", "value"]).groupBy("feature", "key", "v", "r", "w").agg(
        F.sum(F.col("sign") * F.col("start")).alias("n"))     # the row itself included: n = others + 1
    total = near.groupBy("feature").agg(F.sum(digamma(F.col("n")) * F.col("w")).alias("s"), (F.sum("w") / 2).alias("n"))
    mi = F.greatest(F.lit(0.0), digamma(F.col("n").cast("long")) + digamma(F.lit(k)) - F.col("s") / F.col("n"))
    names = spark.createDataFrame([(f,) for f in features], "feature string")
    return names.join(F.broadcast(total.select("feature", mi.alias("relevance"))), "feature", "left").orderBy(
        F.col("relevance").desc(), "feature")
