"""Near-duplicate vectors by sorted projection passes.

Each pass draws 64 random hyperplanes, writes a vector's side of each as one
64-bit word and sorts all vectors by it. Near vectors agree on long prefixes,
so they stand close in most orders; every vector is compared with the next
``window`` vectors of each pass. Pairs whose cosine (double precision) reaches
the threshold are links; where a vector's links still reach the edge of its
window, the window grows fourfold, in bounded tiles, until they stop. The links
of all passes together give the components. The number of passes starts from the
number of vectors and goes by measured recall: a bounded sample of vectors is
compared with all others, and while their links lie in different components too
often (vectors that crowd in one direction share long prefixes without being
near), as many passes again are run with new hyperplanes.

A link never leaves its component, so links are counted there over all pairs,
not over the pairs that some pass met: a component is cut into blocks of bounded
size, and every pair of blocks is one piece of work, so no group can grow hot.
Exact copies are one class before the passes (a group of copies costs one
row), and their links are counted from class sizes.

Defined results
* null vectors, vectors with null or non-finite components, empty vectors and
  zero vectors link with nothing and keep their own row;
* vectors of different length never link;
* identical rows count once; several different vectors under one id are a row
  each, and link like any others;
* a row with a null id links with nothing and stays, with component null and kept
  true;
* empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropframe.llm.common import connected_components, lookup, shuffle_parts, staged
from cropframe.llm.simhash import spanning_links

#: At least so many passes; ``passes_for`` asks for more where the table is large.
PASSES = 48
WINDOW = 64
BLOCK = 4096
THRESHOLD = 0.9
#: Largest chance, over all passes, that a scattered pair right at the threshold never meets.
MISS = 1e-4
#: Rows of a cosine matrix computed at a time.
STRIP = 512
#: Vectors that are compared with all others to measure the passes, and the share of their links that must be met.
PROBES = 2_048
RECALL = 0.998


def passes_for(rows: int, window: int = WINDOW, threshold: float = THRESHOLD) -> int:
    """Passes after which a scattered pair at the threshold has met, but for the chance ``MISS``.

    To stand within a window of evenly spread keys, a pair has to agree on the
    leading log2(rows / window) bits.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(rows, 1) / window))
    return PASSES if agree >= 1 else max(PASSES, math.ceil(math.log(MISS) / math.log1p(-agree)))


def usable(col: str = "vec"):
    """Not null, not empty, all components finite, not all zero."""
    c = F.col(col)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return c.isNotNull() & F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    """Rows scaled to length one in double precision, safe against overflow and underflow."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def pass_keys(x: np.ndarray, seed: int, number: int) -> np.ndarray:
    """One signed 64-bit sort key per row: the sides of 64 random hyperplanes."""
    planes = np.random.default_rng([seed, number, x.shape[1]]).standard_normal((x.shape[1], 64))
    bits = np.packbits(x @ planes > 0, axis=1)
    return bits.view(">u8").ravel().astype(np.uint64).view(np.int64)


def _keys(passes: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            dims = f["vec"].map(len)
            for dim, part in f.groupby(dims):
                x = unit_rows(part["vec"])
                ids = part["rep"].to_numpy()
                for p in range(passes):
                    yield pd.DataFrame({"pass": np.int32(p), "dim": np.int32(dim),
                                        "key": pass_keys(x, seed, p), "rep": ids})
    return run


FOUND = "u long, v long, tree boolean, edge long"


def _found(reps: list, hits: Iterator[tuple[np.ndarray, np.ndarray]], edge: list, spans: bool) -> pd.DataFrame:
    """Links (or only a spanning forest of them), and the ranks whose links reach the edge of the window.

    ``hits`` are pairs of places in ``reps``; ``edge`` is filled while they are drawn.
    """
    none = np.zeros(0, np.int64)
    ids, index = np.unique(np.concatenate([none, *reps]), return_inverse=True)
    hits = ((index[a], index[b]) for a, b in hits)
    if not spans:
        keys = [np.minimum(a, b) * len(ids) + np.maximum(a, b) for a, b in hits]
        keys = np.unique(np.concatenate([none, *keys]))
        u, v = np.divmod(keys, max(len(ids), 1))
        hits = iter([(u, v)])
    tree = spanning_links(len(ids), hits)
    found = pd.DataFrame(np.sort(ids[tree.reshape(-1, 2)], axis=1), columns=["u", "v"]).assign(tree=True)
    if not spans:
        found = pd.DataFrame({"u": ids[u], "v": ids[v]}).merge(found, "left", ["u", "v"])
        found = found.fillna({"tree": False}).astype({"tree": bool})
    edge = pd.DataFrame({"edge": np.unique(np.concatenate([none, *edge]))})
    return pd.concat([found.astype({"u": "Int64", "v": "Int64", "tree": "boolean"}), edge.astype("Int64")])[
        ["u", "v", "tree", "edge"]]


def _neighbours(window: int, threshold: float, spans: bool):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["pass", "dim", "rank"], kind="stable")
        edge = []

        def hits() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at = 0
            for _, part in f.groupby(["pass", "dim"], sort=False):
                x, rank = unit_rows(part["vec"]), part["rank"].to_numpy()
                for step in range(1, min(window, len(part) - 1) + 1):
                    cos = np.einsum("ij,ij->i", x[:-step], x[step:])
                    hit = np.flatnonzero((cos >= threshold) & (rank[step:] - rank[:-step] == step))
                    if step > window - max(1, window // 4):
                        edge.append(rank[hit])
                    yield at + hit, at + hit + step
                at += len(part)
        return _found([f["rep"].to_numpy()], hits(), edge, spans)
    return run


def _further(low: int, high: int, threshold: float, spans: bool):
    """One tile's rows at the edge against a tile that their ranks + (low, high] reach."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["pass", "dim", "asks", "rank"], kind="stable")
        edge = []

        def hits() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at = 0
            for _, part in f.groupby(["pass", "dim"], sort=False):
                x, rank, first = unit_rows(part["vec"]), part["rank"].to_numpy(), int((~part["asks"]).sum())
                y, ry = x[:first], rank[:first]
                for lo in range(first, len(x), STRIP):
                    rx = rank[lo:lo + STRIP]
                    far = ry[None, :] - rx[:, None]
                    hit = (far > low) & (far <= high)
                    if not hit.any():
                        continue
                    hit &= x[lo:lo + STRIP] @ y.T >= threshold
                    edge.append(rx[(hit & (far > high - (high - low) // 4)).any(axis=1)])
                    # one hit of each row and column connects nearly all that the others connect
                    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                    yield at + lo + rows, at + hit[rows].argmax(axis=1)
                    yield at + lo + hit[:, cols].argmax(axis=0), at + cols
                    i, j = np.nonzero(hit)
                    yield at + lo + i, at + j
                at += len(part)
        return _found([f["rep"].to_numpy()], hits(), edge, spans)
    return run


def links(classes: DataFrame, passes: int = PASSES, window: int = WINDOW, threshold: float = THRESHOLD,
          seed: int = 11, block: int = BLOCK, spans: bool = False) -> DataFrame:
    """Verified pairs (u < v) between the distinct vectors of ``classes`` (rep, vec).

    ``tree`` marks pairs that are enough to connect what all pairs connect;
    with ``spans`` the others are left out.
    """
    n = shuffle_parts(classes.sparkSession)
    keys = classes.mapInPandas(_keys(passes, seed), "pass int, dim int, key long, rep long")
    order = ["pass", "dim", "key", "rep"]
    ranked = staged(keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
                    .withColumn("at", F.monotonically_increasing_id()), "passes")
    # the id holds the partition above bit 33 and the place in it below; one count per partition
    part = F.shiftright("at", 33)
    sizes = {r[0]: r[1] for r in ranked.groupBy(part).count().collect()}
    start, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        start.append(total)
        total += sizes.get(k, 0)
    rank = lookup(start or [0], part) + F.col("at").bitwiseAND((1 << 33) - 1)
    ranked = ranked.select("pass", "dim", "rep", rank.alias("rank"))
    own = (F.col("rank") / block).cast("long")
    halo = F.col("rank") % block >= block - window
    placed = ranked.withColumn("block", F.explode(
        F.when(halo, F.array(own, own + 1)).otherwise(F.array(own)))).join(classes, "rep")
    found = staged(placed.groupBy("block").applyInPandas(_neighbours(window, threshold, spans), FOUND), "near")
    pairs, low = found.where("u is not null"), window
    while True:
        edge = staged(found.where("edge is not null").select(F.col("edge").alias("rank")).distinct(), "edge")
        if edge.isEmpty():
            break
        high = 4 * low
        tile = (F.col("rank") / BLOCK).cast("long")
        reach = [((F.col("rank") + d) / BLOCK).cast("long") for d in (low + 1, high)]
        asks = edge.withColumns({"tile": tile, "block": F.explode(F.sequence(*reach))})
        tiles = asks.select("tile", "block").distinct()
        there = ranked.withColumn("block", tile).join(tiles, "block").withColumn("asks", F.lit(False))
        asks = asks.join(ranked, "rank").withColumn("asks", F.lit(True))
        both = asks.unionByName(there).join(classes, "rep")
        found = staged(both.groupBy("tile", "block").applyInPandas(
            _further(low, high, threshold, spans), FOUND), "further")
        pairs, low = pairs.union(found.where("u is not null")), high
    return pairs.groupBy("u", "v").agg(F.max("tree").alias("tree"))


COUNTED = "rep long, others long"


def _count(threshold: float):
    """Sizes of all classes that a class links with: inside each component, or between two blocks of one."""
    def weights(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[i:i + STRIP] @ y.T >= threshold) @ size for i in range(0, len(x), STRIP)])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        reps, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, part in f.groupby(f["vec"].map(len), sort=False):
            part = part.sort_values(["component", "block", "rep"])
            x, rep = unit_rows(part["vec"]), part["rep"].to_numpy()
            size = part["size"].to_numpy().astype(np.int64)
            own = part[["component", "block"]].to_numpy()
            cut = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1), len(part)]
            if part["lo"].iloc[0] < part["hi"].iloc[0]:
                if len(cut) == 3:
                    a, b = slice(0, cut[1]), slice(cut[1], None)
                    reps += [rep[a], rep[b]]
                    others += [weights(x[a], x[b], size[b]), weights(x[b], x[a], size[a])]
            else:
                for lo, hi in zip(cut, cut[1:], strict=False):
                    reps.append(rep[lo:hi])
                    others.append(weights(x[lo:hi], x[lo:hi], size[lo:hi]) - size[lo:hi])
        return pd.DataFrame({"rep": np.concatenate(reps), "others": np.concatenate(others)})
    return run


def count_links(classes: DataFrame, comp: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """rep, others: over all pairs of each component, the rows of the other classes that a class links with."""
    members = staged(classes.join(comp.withColumnRenamed("id", "rep"), "rep").select(
        "component", "rep", "size", "vec"), "members")
    sizes = staged(members.groupBy("component").agg(F.count("*").alias("n")), "component-sizes")
    bins = -(-members.count() // block) or 1
    # components beyond a block: one row per ``block`` vectors at most
    large = sizes.where(F.col("n") > block).select("component", F.ceil(F.col("n") / block).alias("blocks"))
    dealt = members.join(F.broadcast(large), "component", "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks")), F.lit(-1)))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("block") < 0, F.array(F.lit(-1).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    dealt = dealt.select("component", "rep", "size", "vec", "block", F.least("block", "other").alias("lo"),
                         F.greatest("block", "other").alias("hi"), F.when(F.col("block") < 0, F.pmod(
                             F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("deal"))
    counted = dealt.groupBy("deal", "lo", "hi").applyInPandas(_count(threshold), COUNTED)
    return counted.groupBy("rep").agg(F.sum("others").alias("others"))


def _probe(probes, threshold: float):
    """Links of the probes with a batch's vectors, by the component of these: probe, label, links."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, part in f.groupby(f["vec"].map(len)):
                if dim not in probes.value:
                    continue
                reps, x = probes.value[dim]
                labels, at = np.unique(part["label"].to_numpy(), return_inverse=True)
                y, rep = unit_rows(part["vec"]), part["rep"].to_numpy()
                for lo in range(0, len(reps), STRIP):
                    i, j = np.nonzero((x[lo:lo + STRIP] @ y.T >= threshold) & (reps[lo:lo + STRIP, None] != rep))
                    pairs, count = np.unique(i * len(labels) + at[j], return_counts=True)
                    yield pd.DataFrame({"probe": reps[lo + pairs // len(labels)], "label": labels[pairs % len(labels)],
                                        "links": count})
    return run


def recall_of(classes: DataFrame, comp: DataFrame, probes, threshold: float) -> float:
    """Share of the probes' links, of all and of each probe's on average, whose ends lie in one component."""
    labelled = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        "rep", "vec", F.coalesce("component", "rep").alias("label"))
    found = labelled.mapInPandas(_probe(probes, threshold), "probe long, label long, links long")
    own = comp.select(F.col("id").alias("probe"), F.col("component").alias("own"))
    each = found.groupBy("probe", "label").agg(F.sum("links").alias("links")).join(own, "probe", "left").groupBy("probe").agg(
        F.sum("links").alias("links"), F.sum(F.when(F.col("label") == F.col("own"), F.col("links")).otherwise(0)).alias("met"))
    r = each.agg(F.sum("links"), F.sum("met"), F.avg(F.col("met") / F.col("links"))).first()
    return min(r[1] / r[0], r[2]) if r[0] else 1.0


def linked_components(classes: DataFrame, passes: int | None, window: int, threshold: float, seed: int,
                      target: float = RECALL) -> DataFrame:
    """(id, component) of the linked ``classes`` (rep, vec); passes are added until ``target`` of the probes' links are met.

    Adding stops where the passes have cost as many comparisons as all pairs would.
    """
    spark, rows = classes.sparkSession, classes.count()
    sample = classes.orderBy(F.xxhash64("vec"), "rep").limit(PROBES).toPandas()      # bounded by PROBES
    probes = spark.sparkContext.broadcast({dim: (part["rep"].to_numpy(), unit_rows(part["vec"]))
                                           for dim, part in sample.groupby(sample["vec"].map(len))})
    done, more, pairs = 0, passes or passes_for(rows, window, threshold), None
    while True:
        new = links(classes, more, window, threshold, seed + done, spans=True)
        pairs = staged(new if pairs is None else pairs.unionByName(new), "links")
        comp = staged(connected_components(pairs, "vec"), "components")
        done += more
        if done * window >= rows or recall_of(classes, comp, probes, threshold) >= target:
            return comp
        more = done


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    passes: int | None = None, window: int = WINDOW, threshold: float = THRESHOLD,
                    seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector; ``passes`` (the first ones) follows from their number."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    nameless, rows = rows.where("id is null"), rows.where("id is not null").dropDuplicates(["id", "vec"])
    good = staged(rows.where(usable()), "vectors")
    rest = rows.where(~usable()).unionByName(nameless)
    classes = good.groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("size"))
    # a number of its own for each class: an id may stand for several vectors
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    comp = linked_components(classes.select("rep", "vec"), passes, window, threshold, seed)
    linked = count_links(classes, comp, threshold)
    info = staged(classes.join(linked, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(
        "vec", "first", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("label")), "class-info")
    names = info.groupBy("label").agg(F.min("first").alias("component_id"))
    out = good.join(info.join(names, "label"), "vec").select(F.col("id").alias("vec_id"), "n_links", "component_id",
                                                            (F.col("id") == F.col("component_id")).alias("kept"))
    alone = rest.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                        F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)
