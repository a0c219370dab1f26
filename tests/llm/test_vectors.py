"""Embedding near-dedup and exact top-k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropframe.llm import embedding_dedup, topk

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=120, dim=8):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, dim)) * 2
    x = (base[rng.integers(0, 12, n)] + rng.normal(0, 0.25, (n, dim))).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(n)]
    odd = [(200, None, 1), (201, [0.0] * dim, 1), (202, [float("nan")] + [1.0] * (dim - 1), None),
           (203, [float("inf")] + [1.0] * (dim - 1), 1), (204, [], 1), (205, [1.0, 2.0], 1), (206, [1.0, 2.0], 2),
           (207, [None] + [1.0] * (dim - 1), 1), (None, rows[0][1], 1), (300, rows[0][1], 0), (400, rows[0][1], 0),
           rows[3], (500, [1e30] * dim, 0)]
    df = spark.createDataFrame(rows + odd, VEC)
    return df.withColumns({"id": F.lit("x"), "vec": F.lit(1), "rep": F.lit(2), "rank": F.lit(3), "score": F.lit(4)})


def good(rows):
    out = {}
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            out[r["vec_id"]] = np.array(v, dtype=np.float64)
    return out


def test_links_and_components_match_brute_force(spark):
    df = vectors(spark)
    rows = df.collect()
    vs = good(rows)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, passes=24, window=32).collect()}
    links = {a: {b for b in vs if b != a and len(vs[a]) == len(vs[b]) and
                 vs[a] @ vs[b] / np.linalg.norm(vs[a]) / np.linalg.norm(vs[b]) >= 0.9} for a in vs}
    for a in {r["vec_id"] for r in rows}:
        seen, todo = {a}, [a]
        while todo:
            for b in links.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        assert got[a]["n_links"] == len(links.get(a, ()))
        assert got[a]["component_id"] == (None if a is None else min(seen))
        assert got[a]["kept"] == (a is None or a == min(seen))


def test_links_do_not_depend_on_the_layout(spark):
    df = vectors(spark, 300)
    key = lambda d: sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1) for r in d.collect())
    a = embedding_dedup.near_duplicates(df.repartition(1), passes=6, window=4)
    b = embedding_dedup.near_duplicates(df.repartition(7), passes=6, window=4)
    assert key(a) == key(b)


def test_blocks_lose_no_neighbours(spark):
    df = vectors(spark, 300).where("embedding is not null and vec_id < 200")
    classes = df.groupBy(F.col("embedding").alias("vec")).agg(F.min("vec_id").alias("rep"))
    pairs = lambda block: {(r["u"], r["v"]) for r in embedding_dedup.links(classes, 5, 6, block=block).collect()}
    assert pairs(16) == pairs(100_000)


@pytest.mark.parametrize("shard_rows", [1000, 17])
def test_top_k_matches_brute_force(spark, shard_rows):
    df = vectors(spark)
    rows = {}
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) \
                and r["vec_id"] != 500:
            rows[r["vec_id"]] = [int(np.floor(1024 * float(x))) for x in v]
    want = []
    for q in (i for i in rows if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(rows[q], c, strict=True)), i) for i, c in rows.items()
                      if i != q and len(c) == len(rows[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, shard_rows=shard_rows, leaf=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_tables(spark):
    df = spark.createDataFrame([], VEC)
    assert embedding_dedup.near_duplicates(df).count() == 0
    assert topk.top_k(df, F.col("vec_id") % 2 == 0).count() == 0


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.integers(-900, 900, (500, 6))
    tree = topk.BallTree(np.arange(500), x, leaf=8)
    q = rng.integers(-900, 900, (3, 6))
    bound = tree.bounds(q.astype(float))
    for node, (lo, hi) in enumerate(tree.spans):
        assert ((tree.x[lo:hi] @ q.T).max(axis=0) <= bound[:, node]).all()


def test_every_link_of_a_dense_group_counts(spark):
    """One group whose vectors all link, far wider than passes x 2 x window, beside scattered vectors."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    dense = centre / np.linalg.norm(centre) + rng.normal(0, 0.02, (300, 16))
    x = np.concatenate([dense, rng.standard_normal((300, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert want[:300].min() >= 299
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, passes=6, window=4).collect()}
    assert [got[i] for i in range(600)] == want.tolist()


def test_windows_grow_until_links_stop(spark):
    """One pass, equal keys: a link at the far end of a long run of links is found all the same."""
    rows = [(i, [1.0, 1e-6 * i]) for i in range(60)]
    classes = spark.createDataFrame(rows, "rep long, vec array<float>")
    assert embedding_dedup.links(classes, 1, 4).count() == 60 * 59 // 2


def test_blocks_of_a_component_count_like_one(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal(8) + rng.normal(0, 0.25, (200, 8))).astype(np.float32).astype(np.float64)
    classes = spark.createDataFrame([(i, [float(c) for c in v], 1 + i % 3) for i, v in enumerate(x)],
                                    "rep long, vec array<float>, size long")
    comp = classes.select(F.col("rep").alias("id"), F.lit(0).cast("long").alias("component"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    size = np.array([1 + i % 3 for i in range(200)])
    want = (unit @ unit.T >= 0.9) @ size - size
    for block in (7, 64, 4096):
        got = dict(map(tuple, embedding_dedup.count_links(classes, comp, block=block).collect()))
        assert [got[i] for i in range(200)] == want.tolist()


def test_passes_follow_from_the_rows():
    assert embedding_dedup.passes_for(0) == embedding_dedup.passes_for(6_000) == embedding_dedup.PASSES
    assert embedding_dedup.passes_for(10**6) > embedding_dedup.PASSES
    assert embedding_dedup.passes_for(10**8) > embedding_dedup.passes_for(10**6)


def test_crowded_vectors_are_met(spark):
    """Vectors that all point one way (mean cosine 0.8), with pairs at 0.905 among them: passes go on until they are met."""
    rng = np.random.default_rng(6)
    n, dim, planted = 4000, 128, 400
    common = rng.standard_normal(dim)
    common /= np.linalg.norm(common)

    def around(centre, cosine, k):
        y = rng.standard_normal((k, dim))
        y -= (y @ centre.T if centre.ndim == 1 else np.einsum("ij,ij->i", y, centre))[:, None] * centre
        return cosine * centre + np.sqrt(1 - cosine ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)

    x = around(common, np.sqrt(0.8), n)
    x[n - planted:] = around(x[:planted], 0.905, planted)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    links = (y @ y.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, passes=8, window=8).collect()}
    met = sum(got[i]["n_links"] for i in range(n)) / links.sum()
    assert links.sum() >= 2 * 0.9 * planted and met >= 0.99
    few = embedding_dedup.links(df.select(F.col("vec_id").alias("rep"), F.col("embedding").alias("vec")), 8, 8)
    assert few.count() < 0.7 * links.sum() / 2      # the first passes alone would not do


def test_rows_of_one_id_and_without_id_stay(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (None, [1.0, 0.0]), (None, [1.0, 0.0]),
            (None, None), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(embedding_dedup.near_duplicates(df).collect(), key=str)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None) == [
        (1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True)]
    assert sum(r["vec_id"] is None and r["n_links"] == 0 and r["kept"] for r in got) == 3


def test_long_vectors_are_searched(spark):
    rows = [(0, [1.0, 0.0]), (1, [2e6, 0.0]), (2, [0.5, 0.5]), (3, [-2e9, 1e9]), (4, [3e15, 3e15]), (5, [1e30, 0.0]), (6, [-3e15, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") < 5, k=3).collect()}
    x = {i: [int(np.floor(1024 * v)) for v in e] for i, e in rows if i != 5}
    for q in range(5):
        score = {i: sum(a * b for a, b in zip(x[q], c, strict=True)) for i, c in x.items() if i != q}
        best = sorted((-max(-2 ** 63, min(2 ** 63 - 1, s)), i) for i, s in score.items())[:3]
        assert [got[(q, k + 1)] for k in range(3)] == [(i, -s) for s, i in best]
