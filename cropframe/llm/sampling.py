"""Bounded training samples and a small logistic regression for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import fresh


def held_out(id_col: str | Column) -> Column:
    """Rows that never train: CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"))
                      % 3 == 1, F.lit(False))


def sample_ids(ids: DataFrame, id_col: str, limit: int, salt: int) -> DataFrame:
    """At most ``limit`` rows, the same ones in every run: those with the smallest salted hashes."""
    return ids.orderBy(F.xxhash64(F.col(id_col), F.lit(salt)), id_col).limit(limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, salt: int = 5,
                    id_col: str = "doc_id") -> DataFrame:
    """Documents with a 0/1 ``label`` outside the held-out third, at most ``limit`` of them.

    The sample's ids are bounded by ``limit``, so they are broadcast to the scan.
    """
    ok = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(id_col))
    key = fresh(docs, "sampled_id")[0]
    one = ok.groupBy(F.col(id_col).alias(key)).agg(F.max(label).cast("int").alias("label"))
    picked = sample_ids(one, key, limit, salt)
    return docs.join(F.broadcast(picked), F.col(id_col) == F.col(key)).drop(key)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Logistic:
    """L2 logistic regression on standardised features, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0):
        weight = np.ones(len(y)) if weight is None else weight
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        std = x.std(axis=0) if len(x) else np.ones(x.shape[1])
        self.std = np.where(std > 1e-9, std, 1.0)
        z = np.hstack([(x - self.mean) / self.std, np.ones((len(x), 1))])
        self.coef = np.zeros(z.shape[1])
        if len(np.unique(y)) < 2:  # one class or none: its smoothed share
            p = (y.sum() + 1) / (len(y) + 2)
            self.coef[-1] = np.log(p / (1 - p))
            return
        penalty = np.full(z.shape[1], l2)
        penalty[-1] = 1e-6
        for _ in range(50):
            p = sigmoid(z @ self.coef)
            g = z.T @ (weight * (p - y)) + penalty * self.coef
            h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
            step = np.linalg.solve(h, g)
            size = np.abs(step).max()
            self.coef -= step * min(1.0, 5.0 / max(size, 1e-12))
            if size < 1e-8:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std) @ self.coef[:-1] + self.coef[-1]
