"""SimHash near-duplicates with BK-trees.

A document's fingerprint has a bit set where over half of its shingle hashes
(XXH64, seed 42) have it. Two fingerprints within ``radius`` bits are linked.

Any two 64-bit words within 3 bits agree on at least one of four 16-bit bands,
so every distinct fingerprint enters one shard per band (radius + 1 bands in
general). A shard is a BK-tree: the children of a node are keyed by their
integer Hamming distance d to it, and a search that is at distance x from a
node follows only the edges with |d - x| <= radius. The trees of all
fingerprints have no size bound, so a tree is not broadcast to all tasks: it
goes to the one task that holds the fingerprints of its band value. A band
value with more fingerprints than a tree may hold is dealt over several trees,
and its fingerprints, in blocks, visit each of them.

Searches run breadth-first on whole arrays of (searcher, node) pairs, in slices
of bounded length. A task reports a spanning forest of its links instead of
all pairs, which keeps every component whole.

Defined results
* null or empty texts and texts without words: fingerprint zero, linked like any other;
* fewer words than a shingle: the whole word sequence is the one shingle;
* exact copies share a fingerprint, hence a component;
* rows with a null id keep their row, with the component of their fingerprint;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import connected_components, fresh, staged

SEED = 42
TREE_ROWS = 4096
GROUP_ROWS = 50_000
SLICE = 1 << 20


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = words_per_shingle
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k \
        else [b" ".join(words)]
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), 1 << 16):
        part = h[lo:lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _fingerprints(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words_per_shingle) for t in b["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])
    return run


class BKForest:
    """BK-trees over several shards at once; node i is point i, children sorted by (node, distance)."""

    def __init__(self, points: np.ndarray, shard: np.ndarray):
        n = len(points)
        self.points = points
        order = np.argsort(shard, kind="stable")
        first = np.ones(n, dtype=bool)
        first[1:] = shard[order][1:] != shard[order][:-1]
        self.roots = dict(zip(shard[order][first].tolist(), order[first].tolist(), strict=True))
        at = np.empty(n, dtype=np.int64)  # the node that each unplaced point stands at
        at[order] = order[first][np.cumsum(first) - 1]
        left = np.setdiff1d(np.arange(n), order[first])
        parents, dists, kids = [], [], []
        while len(left):
            d = np.bitwise_count(points[left] ^ points[at[left]]).astype(np.int64)
            slot = np.lexsort((left, d, at[left]))
            left, d = left[slot], d[slot]
            new = np.ones(len(left), dtype=bool)
            new[1:] = (at[left][1:] != at[left][:-1]) | (d[1:] != d[:-1])
            parents.append(at[left][new])
            dists.append(d[new])
            kids.append(left[new])
            at[left] = left[new][np.cumsum(new) - 1]
            left = left[~new]
        none = np.zeros(0, dtype=np.int64)
        parents, dists, kids = (np.concatenate(a) if a else none for a in (parents, dists, kids))
        self.edge = parents * 128 + dists
        o = np.argsort(self.edge, kind="stable")
        self.edge, self.kids = self.edge[o], kids[o]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) within ``radius``; only edges keyed within ``radius`` of the distance are followed."""
        stack = [(np.arange(len(queries)), roots)]
        while stack:
            q, node = stack.pop()
            if len(q) > SLICE:
                stack += [(q[SLICE:], node[SLICE:])]
                q, node = q[:SLICE], node[:SLICE]
            d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.edge, node * 128 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.edge, node * 128 + np.minimum(d + radius, 127), "right")
            n = hi - lo
            if n.sum():
                nxt = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                stack.append((np.repeat(q, n), self.kids[nxt]))


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Root of each x, by pointer jumping over whole arrays."""
    x = parent[x]
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def spanning_links(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """At most n - 1 of the given links that connect the same points."""
    parent = np.arange(n)
    kept = []
    for a, b in pairs:
        while len(a):
            ra, rb = _roots(parent, a), _roots(parent, b)
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            hi, one = np.unique(hi, return_index=True)  # each root is hung once a round
            parent[hi] = lo[one]
            kept.append(np.stack([a[one], b[one]], axis=1))
    return np.concatenate(kept) if kept else np.zeros((0, 2), dtype=np.int64)


def _link(radius: int):
    """Links of one group of shards; kind 0 rows are tree points, kind 1 rows search them."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        tree = f[f["kind"] == 0].sort_values(["unit", "rep"])
        ask = f[f["kind"] == 1].sort_values(["unit", "rep"])
        points = tree["fp"].to_numpy(np.int64).view(np.uint64)
        forest = BKForest(points, tree["unit"].to_numpy())
        reps = np.concatenate([tree["rep"].to_numpy(), ask["rep"].to_numpy()])
        ids, index = np.unique(reps, return_inverse=True)
        node, asker = index[:len(tree)], index[len(tree):]
        roots = np.array([forest.roots.get(u, -1) for u in ask["unit"].tolist()], dtype=np.int64)
        q = ask["fp"].to_numpy(np.int64).view(np.uint64)
        live = np.flatnonzero(roots >= 0)
        found = ((asker[live[a]], node[b]) for a, b in forest.search(q[live], roots[live], radius))
        kept = spanning_links(len(ids), found)
        return pd.DataFrame({"u": ids[kept[:, 0]], "v": ids[kept[:, 1]]})
    return run


def _bands(radius: int):
    """(shift, width) of radius + 1 bands that cover 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def fingerprint_links(classes: DataFrame, radius: int = 3, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (rep, fp) within ``radius`` bits."""
    band = F.array(*[F.struct(F.lit(i).alias("band"),
                              F.expr(f"shiftrightunsigned(fp, {s}) & {(1 << w) - 1}L").alias("value"))
                     for i, (s, w) in enumerate(_bands(radius))])
    rows = classes.select("rep", "fp", F.explode(band).alias("b")).select("rep", "fp", "b.band", "b.value")
    hot = rows.groupBy("band", "value").agg(F.count("*").alias("m")).where(F.col("m") > tree_rows)
    hot = hot.select("band", "value", F.ceil(F.col("m") / tree_rows).cast("int").alias("parts"))
    rows = rows.join(staged(hot, "hot-shards"), ["band", "value"], "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), "parts").cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # cell (tree part, block of searchers): a point of part p is in tree p for all blocks, and searches all trees
    cells = F.concat(F.transform(every, lambda o: F.struct(F.lit(0).alias("kind"), mine.alias("part"), o.alias("block"))),
                     F.transform(every, lambda o: F.struct(F.lit(1).alias("kind"), o.alias("part"), mine.alias("block"))))
    cells = rows.withColumn("c", F.explode(cells)).select(
        "rep", "fp", "c.kind", F.xxhash64("band", "value", "c.part", "c.block").alias("unit"))
    groups = max(1, -(-8 * classes.count() // GROUP_ROWS))
    return (cells.withColumn("g", F.pmod("unit", F.lit(groups))).groupBy("g")
            .applyInPandas(_link(radius), "u long, v long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit), component_id of every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = staged(texts.mapInArrow(_fingerprints(words_per_shingle), "doc_id long, fp long"), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    links = fingerprint_links(classes.where("rep is not null"), radius)
    comp = connected_components(links, "simhash").withColumnRenamed("id", "rep")
    known = staged(classes.join(comp, "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")), "fingerprint-components")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """16 lower-case hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents whose id is the smallest of their component, all columns kept.

    Rows with a null id are kept (they can be nobody's copy by id); of rows
    that repeat both an id and a text one stays.
    """
    found = near_duplicates(docs, id_col, text_col, words_per_shingle, radius)
    key = fresh(docs, "first_id")[0]
    first = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key)).distinct()
    kept = docs.join(first, F.col(id_col) == F.col(key), "left_semi").dropDuplicates([id_col, text_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
