"""Exact Shapley values of tree ensembles (E3), leaf by leaf.

With the interventional value function, a leaf adds its value to f(x_S, b_rest)
exactly if every feature on its path is met by x (for features in S) or by the
background row b (for the others). So a pair (x, b) takes part in a leaf only
through two bit patterns: which of the path's k features x meets, and which b
meets. If u features are met by x alone and v by b alone, and none by neither,
every one of the u gets (u-1)! v! / (u+v)! of the leaf's value and every one of
the v loses u! (v-1)! / (u+v)! of it (the game of a leaf, solved in closed form).

The background enters as counted patterns per leaf and the rows as distinct
patterns per batch, so the work is leaves x patterns: no row is copied per
coalition or per background row. The flattened trees are broadcast (their size
follows from the model alone and is checked), rows stream through in Arrow
batches, nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of flattened trees that are broadcast.
MOST_BYTES = 512 << 20

#: Rows whose patterns are worked on together.
BATCH = 2_048

_TREE = re.compile(r"\s*Tree \d+ \(weight ([^)]+)\):")
_NODE = re.compile(r"(\s+)(?:(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)|Predict: (\S+))$")


class Leaf:
    """Value of a leaf and the interval (low, high] of every feature on its path."""

    __slots__ = ("value", "features", "low", "high")

    def __init__(self, value: float, path: list[tuple[int, str, float]]):
        box: dict[int, list[float]] = {}
        for j, side, t in path:
            b = box.setdefault(j, [-math.inf, math.inf])
            if side == "<=":
                b[1] = min(b[1], t)
            else:
                b[0] = max(b[0], t)
        self.value = value
        self.features = np.array(sorted(box), dtype=np.int64)
        self.low = np.array([box[j][0] for j in sorted(box)])
        self.high = np.array([box[j][1] for j in sorted(box)])

    def pattern(self, x: np.ndarray) -> np.ndarray:
        """Bit i is set where the row meets the path's i-th feature."""
        v = x[:, self.features]
        return ((v > self.low) & (v <= self.high)) @ (1 << np.arange(len(self.features), dtype=np.int64))


def leaves_of(text: str, thresholds=None) -> list[list[Leaf]]:
    """The leaves of every tree in a model's printed form, with the tree's weight in their values.

    ``thresholds(tree, feature, t)`` translates the thresholds of coded features.
    A split by categories raises ValueError.
    """
    trees, weight, path, base = [], 1.0, [], None
    for line in text.splitlines()[1:]:
        head = _TREE.match(line)
        if head:
            trees.append([])
            weight, base = float(head[1]), None
            continue
        m = _NODE.match(line)
        if not m:
            if line.strip():
                raise ValueError(f"not a numeric split: {line.strip()}")
            continue
        if not trees:  # a single tree has no heading
            trees.append([])
        base = len(m[1]) if base is None else base
        level = len(m[1]) - base
        del path[level:]
        if m[5]:
            trees[-1].append(Leaf(weight * float(m[5]), path))
        else:
            j, t = int(m[2]), float(m[4])
            path.append((j, m[3], thresholds(len(trees) - 1, j, t) if thresholds else t))
    return trees


def flattened(last) -> list[Leaf] | None:
    """All leaves of a fitted ensemble whose prediction is the sum of its trees, else None."""
    from cropframe.operators.model import ExtraTreesModel

    try:
        if isinstance(last, ExtraTreesModel):
            def value(tree: int, j: int, t: float) -> float:
                cuts, m = last.cuts[tree][j], math.floor(t)  # code <= m means x <= the m-th cut
                return -math.inf if m < 0 else cuts[m] if m < len(cuts) else math.inf

            trees = []
            for i, tree in enumerate(last.trees):
                trees += leaves_of(tree.toDebugString, lambda _, j, t, i=i: value(i, j, t))
            share = 1.0 / len(trees)
        elif isinstance(last, (DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel)):
            trees = leaves_of(last.toDebugString)
            share = 1.0 / len(trees) if isinstance(last, RandomForestRegressionModel) else 1.0
        else:
            return None
    except ValueError:
        return None
    for leaf in (leaf for tree in trees for leaf in tree):
        leaf.value *= share
    return [leaf for tree in trees for leaf in tree]


def slots(model: PipelineModel, features: list[str]) -> list[str] | None:
    """The feature behind every slot of the assembled vector, or None if other columns enter it."""
    made = [s for s in model.stages if isinstance(s, VectorAssembler)]
    if len(made) != 1:
        return None
    names = [c.removesuffix("__imp") for c in made[0].getInputCols()]
    return names if sorted(names) == sorted(features) else None


class LeafGames:
    """Closed-form Shapley values of the leaves against counted background patterns."""

    def __init__(self, leaves: list[Leaf], background: np.ndarray, width: int):
        self.width, self.base, self.parts = width, 0.0, []
        most = max((len(f.features) for f in leaves), default=0) + 1
        fact = [math.factorial(i) for i in range(2 * most + 1)]
        self.gain = np.array([[fact[u - 1] * fact[v] / fact[u + v] if u else 0.0 for v in range(most)] for u in range(most)])
        self.loss = self.gain.T
        for leaf in leaves:
            seen, count = np.unique(leaf.pattern(background), return_counts=True)
            share = count / len(background)
            full = (1 << len(leaf.features)) - 1
            self.base += leaf.value * float(share[seen == full].sum())
            self.parts.append((leaf, seen, share, full))

    def values(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(Shapley values, predictions) of the rows of ``x``."""
        phi, out = np.zeros((len(x), self.width)), np.zeros(len(x))
        for leaf, seen, share, full in self.parts:
            own, back = np.unique(leaf.pattern(x), return_inverse=True)
            out += np.where(own == full, leaf.value, 0.0)[back]
            alive = (own[:, None] | seen[None, :]) == full
            if not alive.any():
                continue
            mine, theirs = own[:, None] & ~seen[None, :], seen[None, :] & ~own[:, None]
            u, v = np.bitwise_count(mine), np.bitwise_count(theirs)
            u, v = np.where(alive, u, 0), np.where(alive, v, 0)
            plus, minus = self.gain[u, v] * share, self.loss[u, v] * share
            part = np.empty((len(own), len(leaf.features)))
            for i in range(len(leaf.features)):
                part[:, i] = (plus * (mine >> i & 1) - minus * (theirs >> i & 1)).sum(axis=1)
            phi[:, leaf.features] += leaf.value * part[back]
        return phi, out


def tree_shap(model: PipelineModel, df: DataFrame, keys: list[str], features: list[str],
              background: np.ndarray) -> DataFrame | None:
    """(keys, feature, shap, base, prediction) of every row, exact for any number of features.

    ``background`` has a row per background row and a column per feature, NaN
    for a missing value. None if the model is no sum of numeric trees over
    just these features.
    """
    names, leaves = slots(model, features), flattened(model.stages[-1])
    if names is None or leaves is None:
        return None
    size = sum(leaf.features.nbytes * 3 + 8 for leaf in leaves)
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of flattened trees are too many to broadcast")
    fill = next((s.surrogateDF.first().asDict() for s in model.stages if isinstance(s, ImputerModel)), {})
    surrogate = np.array([float(fill.get(f, math.nan)) for f in names])
    order = [features.index(f) for f in names]

    def ready(x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), surrogate, x)
        return np.where(np.isnan(x), math.inf, x)  # a missing value fails every "at most"

    sent = df.sparkSession.sparkContext.broadcast((leaves, ready(background[:, order])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        games = None
        for frame in frames:
            games = games or LeafGames(*sent.value, len(names))
            x = ready(frame[[f"_f{j}" for j in order]].to_numpy(dtype=float, na_value=math.nan))
            for lo in range(0, len(frame), BATCH):
                phi, out = games.values(x[lo:lo + BATCH])
                part = frame[keys].iloc[lo:lo + BATCH].loc[lambda d: d.index.repeat(len(names))].reset_index(drop=True)
                part["feature"] = names * len(phi)
                part["shap"] = phi.ravel()
                part["base"] = games.base
                part["prediction"] = np.repeat(out, len(names))
                yield part

    rows = df.select(*keys, *[F.col(f).cast("double").alias(f"_f{j}") for j, f in enumerate(features)])
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("feature", T.StringType()), T.StructField("shap", T.DoubleType()),
        T.StructField("base", T.DoubleType()), T.StructField("prediction", T.DoubleType())])
    return rows.mapInPandas(run, schema)
