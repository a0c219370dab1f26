"""Exact top-k inner-product search with a ball tree per shard.

Candidates are hashed into shards of bounded size. The task that owns a shard
builds its ball tree and answers every query against it by branch and bound:
nodes are taken in the order of their upper bound  q.centre + |q| * radius,
and the search of a query stops at the first node whose bound is below the
query's current k-th score.

The k-th score travels between shards: the first round searches only the
query's home shard, and its k-th score is the floor that every other shard
starts from. Queries reach a shard as a stream of small batches, so a task
holds one shard and one batch, however many queries there are.

Defined results
* vectors that are null or hold null or non-finite components take no part, nor
  do those with a component that is no 64-bit integer once scaled;
* scores are exact; where two vectors are so long that their score could leave
  64 bits it is computed in big integers, and one that does leave them reads as
  the largest or smallest 64-bit integer;
* vectors of another length than the query's are no candidates of it;
* empty vectors score 0 with each other;
* rows with a null id take no part; identical rows count once, and of several
  different vectors under one id the smallest (in array order) counts;
* ties go to the smaller id; fewer than k candidates give fewer rows;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import staged

LEAF = 64
SHARD_ROWS = 8192


class BallTree:
    """Ball tree over integer rows: halves along the widest spread, down to ``leaf`` rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.order = np.lexsort((ids,))
        self.centres, self.radii, self.spans, self.kids = [], [], [], []
        self._x = x
        self._leaf = leaf
        if len(ids):
            self._grow(0, len(ids))
        self.ids, self.x = ids[self.order], x[self.order]
        self.longest = float(np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1).max())) if len(ids) else 0.0
        self.centres = np.array(self.centres).reshape(len(self.radii), x.shape[1])
        self.radii = np.array(self.radii)
        del self._x

    def _grow(self, lo: int, hi: int) -> int:
        rows = self._x[self.order[lo:hi]]
        centre = rows.mean(axis=0)
        node = len(self.radii)
        self.centres.append(centre)
        self.radii.append(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        self.spans.append((lo, hi))
        self.kids.append(None)
        if hi - lo > self._leaf and self.radii[node] > 0:
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            half = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows[:, axis], half)]
            self.kids[node] = (self._grow(lo, lo + half), self._grow(lo + half, hi))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with anything below each node."""
        lengths = np.sqrt((queries ** 2).sum(axis=1))
        exact = queries @ self.centres.T + lengths[:, None] * self.radii
        return exact + 1e-9 * (np.abs(exact) + 1) + 1e-9 * lengths[:, None] * (
            np.sqrt((self.centres ** 2).sum(axis=1)) + self.radii)

    def search(self, query: np.ndarray, own: int, k: int, floor: float, bound: np.ndarray) -> list[tuple[int, int]]:
        """Up to k best (score, -id) of the tree with a score of at least ``floor``."""
        best: list[tuple[int, int]] = []
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        todo = [(-bound[0], 0)] if len(self.ids) else []
        while todo:
            top, node = heapq.heappop(todo)
            if -top < (best[0][0] if len(best) == k else floor):
                break
            if self.kids[node] is not None:
                for kid in self.kids[node]:
                    if bound[kid] >= (best[0][0] if len(best) == k else floor):
                        heapq.heappush(todo, (-bound[kid], kid))
                continue
            lo, hi = self.spans[node]
            if length * self.longest < 2.0 ** 62:
                scores = self.x[lo:hi] @ query
            else:
                exact = self.x[lo:hi].astype(object) @ query.astype(object)
                scores = np.array([min(max(int(s), -2 ** 63), 2 ** 63 - 1) for s in exact], dtype=np.int64)
            least = best[0][0] if len(best) == k else floor
            for i in np.flatnonzero(scores >= least):
                item = (int(scores[i]), -int(self.ids[lo + i]))
                if -item[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def quantised(vec: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def searchable(vec: Column, scale: int = 1024) -> Column:
    """All components finite, and 64-bit integers once scaled."""
    fits = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < 2.0 ** 63))
    return vec.isNotNull() & F.coalesce(fits, F.lit(False))


def _run(k: int, leaf: int):
    """One sorted stream of (shard, dim, kind): first a shard's rows, then the queries sent to it."""

    def answer(tree: BallTree, f: pd.DataFrame) -> pd.DataFrame:
        q = np.array(f["vec"].tolist(), dtype=np.int64).reshape(len(f), -1)
        bound = tree.bounds(q.astype(np.float64))
        out = []
        for i, (qid, floor) in enumerate(zip(f["id"], f["floor"], strict=True)):
            low = -np.inf if pd.isna(floor) else floor
            out += [(int(qid), -nid, s) for s, nid in tree.search(q[i], int(qid), k, low, bound[i])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, rows, tree = None, [], [], None
        for f in frames:
            for key, part in f.groupby(["shard", "dim"], sort=False):
                if key != at:
                    at, ids, rows, tree = key, [], [], None
                members = part[part["kind"] == 0]
                if len(members):
                    ids.append(members["id"].to_numpy(np.int64))
                    rows.append(np.array(members["vec"].tolist(), dtype=np.int64).reshape(len(members), -1))
                asked = part[part["kind"] == 1]
                if len(asked) and rows:
                    if tree is None:
                        tree = BallTree(np.concatenate(ids), np.concatenate(rows), leaf)
                    for lo in range(0, len(asked), 256):
                        yield answer(tree, asked.iloc[lo:lo + 256])
    return run


def _round(members: DataFrame, asked: DataFrame, k: int, leaf: int, shards: int) -> DataFrame:
    cols = ["shard", "dim", "kind", "id", "vec", "floor"]
    both = members.select(*cols).union(asked.select(*cols))
    return (both.repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind", "id")
            .mapInPandas(_run(k, leaf), "query_id long, vec_id long, score long"))


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(candidates: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
          k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row."""
    rows = candidates.where(F.col(id_col).isNotNull() & searchable(F.col(vec_col), scale))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("raw"),
                       F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id").agg(F.min("raw").alias("raw"), F.max("asks").alias("asks"))
    rows = rows.select("id", "asks", quantised(F.col("raw"), scale).alias("vec"), F.size("raw").alias("dim"))
    rows = staged(rows, "candidates")
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    members = rows.withColumn("kind", F.lit(0)).withColumn("floor", F.lit(None).cast("long"))
    queries = rows.where("asks").withColumn("kind", F.lit(1)).withColumn("floor", F.lit(None).cast("long"))
    home = staged(_round(members, queries, k, leaf, shards), "home-round")
    # a full home list gives the floor; a shorter one leaves the query unbounded
    floors = home.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    floors = floors.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("low")).alias("known"))
    away = (queries.withColumnRenamed("shard", "home").join(floors, "id", "left")
            .withColumn("floor", F.col("known"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
            .where("shard <> home"))
    found = home.unionByName(_round(members, away, k, leaf, shards)) if shards > 1 else home
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
