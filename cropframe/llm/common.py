"""Helpers shared by the training-data operators.

Nothing here keeps state on one machine: staged tables go to the shared folder
named by ``spark.checkpoint.dir`` and cut the lineage, so a lost executor costs
a re-read and not a re-computation.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.session import scratch_path


_HELD: dict = {}


def held(key, make):
    """One object per Python worker, kept between tasks until another operator takes its place.

    Workers outlive stages; with one place, the caches of a pipeline's earlier
    stages do not add up.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them (letter case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(values: Sequence[int], index: Column) -> Column:
    """``values[index]`` for a short driver-side list, as one literal array in the plan."""
    table = F.from_json(F.lit(json.dumps(list(values))), F.lit("array<bigint>"))
    return F.element_at(table, (index + 1).cast("int"))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component) of every node in ``edges`` (u, v: long): the smallest id reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Each
    round is two joins against per-node minima; the minima are staged first, so
    both join sides are plain exchanges that adaptive execution splits when a
    node is the centre of very many edges. Self-loops and repeated edges are
    harmless; null ends are dropped. An empty input gives an empty result.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = staged(e.where("u is not null and v is not null and u <> v").distinct(), f"{name}-edges")
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-min")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), f"{name}-large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-min")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v")))
        e = staged(small.distinct(), f"{name}-small")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
