"""The phi_k correlation of columns of any kind (Baak et al., 2018).

phi_k of a contingency table is the correlation of the bivariate normal
distribution that, binned alike, has the table's chi-square: above a pedestal
for statistical noise, scaled so that the largest chi-square a table of that
shape can have belongs to correlation 1.

The tables of all pairs come from one scan (numeric columns in equal-width
bins); what reaches the driver is four numbers a pair, on which the root is
searched.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.operators.profile import HIST_BINS, equal_width_codes, pair_cells, with_margins

SPAN = 5.0          # the normal's bins are equally wide between -SPAN and SPAN; the outer ones are open
NODES = 128
_AT, _WEIGHT = np.polynomial.legendre.leggauss(NODES)


def _normal(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])


class NormalTable:
    """Mean square contingency of the bivariate normal in r x k bins, as a function of its correlation."""

    def __init__(self, r: int, k: int):
        self.x, self.y = (np.linspace(-SPAN, SPAN, m + 1)[1:-1] for m in (r, k))
        self.px, self.py = (np.diff(np.r_[0.0, _normal(e), 1.0]) for e in (self.x, self.y))

    def excess(self, rho: float) -> np.ndarray:
        """P(X <= x, Y <= y) - P(X <= x) P(Y <= y) at the inner edges.

        Its derivative in the correlation is the bivariate density (Plackett), so
        with the correlation as the sine of an angle it is a smooth integral.
        """
        if rho >= 1.0:
            return _normal(self.x)[:, None] + 0 * self.y - np.maximum(
                0.0, _normal(self.x)[:, None] - _normal(self.y)) - np.outer(_normal(self.x), _normal(self.y))
        out = np.empty((len(self.x), len(self.y)))
        half = math.asin(rho) / 2
        angle = half * (_AT + 1)
        sine, cos2 = np.sin(angle), np.cos(angle) ** 2
        step = max(1, (1 << 21) // max(1, len(self.y) * NODES))     # a bounded block of rows at a time
        for lo in range(0, len(self.x), step):
            h, k = self.x[lo:lo + step, None, None], self.y[None, :, None]
            out[lo:lo + step] = (np.exp(-(h * h + k * k - 2 * h * k * sine) / (2 * cos2)) * _WEIGHT).sum(axis=2)
        return out * half / (2 * math.pi)

    def contingency(self, rho: float) -> float:
        """Sum over cells of (p - p_x p_y)^2 / (p_x p_y)."""
        d = np.pad(self.excess(rho), 1)
        cell = d[1:, 1:] - d[:-1, 1:] - d[1:, :-1] + d[:-1, :-1]
        return float((cell * cell / np.outer(self.px, self.py)).sum())


def phik(chi2: float, n: float, r: int, k: int, noise: bool = True) -> float | None:
    """phi_k of an r x k table of n rows with this chi-square; None where a side does not vary.

    The pedestal is the degrees of freedom, the mean of a chi-square without
    any association; with ``noise=False`` it is zero.
    """
    if r < 2 or k < 2:
        return None
    pedestal, most = float((r - 1) * (k - 1)) if noise else 0.0, n * min(r - 1, k - 1)
    if chi2 <= pedestal or most <= pedestal:
        return 0.0
    share = (chi2 - pedestal) / (most - pedestal)
    if share >= 1.0:
        return 1.0
    table = NormalTable(r, k)
    want, lo, hi = share * table.contingency(1.0), 0.0, 1.0
    while lo < (mid := 0.5 * (lo + hi)) < hi and hi - lo > 1e-13:
        lo, hi = (lo, mid) if table.contingency(mid) >= want else (mid, hi)
    return 0.5 * (lo + hi)


def phik_matrix(df: DataFrame, numeric: list[str], categorical: list[str] | None = None, bins: int = HIST_BINS,
                noise: bool = True) -> DataFrame:
    """(x, y, phik) of all column pairs; NULL and NaN leave a pair's table, empty bins its shape.

    The root search costs r x k per step on the driver (columns with very
    many categories are better left out, as their tables hold no evidence).
    """
    spark, schema = df.sparkSession, "x string, y string, phik double"
    pairs = list(combinations(numeric + (categorical or []), 2))
    if not pairs:
        return spark.createDataFrame([], schema)
    j = with_margins(pair_cells(df, pairs, equal_width_codes(df, numeric, bins)))
    o, ri, cj = (F.col(c).cast("double") for c in ("count", "r_i", "c_j"))
    found = {t["pair"]: t for t in j.groupBy("pair").agg(
        F.sum(o).alias("n"), F.sum(o * o / (ri * cj)).alias("q"), F.round(F.sum(o / ri)).cast("int").alias("r"),
        F.round(F.sum(o / cj)).cast("int").alias("k")).collect()}      # a row per pair
    rows = []
    for i, (a, b) in enumerate(pairs):
        t = found.get(i)
        rows.append((a, b, phik(t["n"] * t["q"] - t["n"], t["n"], t["r"], t["k"], noise) if t else None))
    return spark.createDataFrame(rows, schema)
