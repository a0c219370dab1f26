"""Keyed upserts without MERGE (W2, W3, J6, K1-K3, publish sink).

Last-write-wins inside a batch is an aggregate, not a window:
``max_by(struct(values), order)`` is a partial aggregate, so a key that
holds a third of the batch is reduced map-side to one row per task before
the shuffle. ``order`` must be a total order within a key (e.g. file,
block, row of the landed file).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.session import drop_path, scratch_path


def _order(order: list[str] | str):
    order = [order] if isinstance(order, str) else list(order)
    return F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])


def last_per_key(df: DataFrame, keys: list[str], order: list[str] | str,
                 keep_order: bool = False) -> DataFrame:
    """The last row of each key by ``order``; every column comes from that row."""
    order_cols = [order] if isinstance(order, str) else list(order)
    values = [c for c in df.columns if c not in keys and (keep_order or c not in order_cols)]
    if not values:
        return df.select(*keys).distinct()
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*values), _order(order)).alias("_v"))
    return last.select(*keys, *[F.col(f"_v.`{c}`").alias(c) for c in values])


def reduce_batch(df: DataFrame, keys: list[str], order: list[str] | str,
                 overwrite: list[str], keep_if_null: list[str]) -> DataFrame:
    """W2 + W3 in one aggregate: ``overwrite`` columns from the last row (even
    NULL), ``keep_if_null`` columns as the last non-NULL value of the key."""
    o = _order(order)
    aggs = []
    if overwrite:
        aggs.append(F.max_by(F.struct(*overwrite), o).alias("_v"))
    for c in keep_if_null:
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c))
    red = df.groupBy(*keys).agg(*aggs)
    return red.select(*keys, *[F.col(f"_v.`{c}`").alias(c) for c in overwrite], *keep_if_null)


def merge(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | str,
          overwrite: list[str], keep_if_null: list[str] = (), null_safe: bool = False) -> DataFrame:
    """Upsert ``batch`` into ``target`` by natural key.

    A key only in the target keeps its row; a key in the batch takes the
    batch's ``overwrite`` values and, for ``keep_if_null`` columns, the
    batch's last non-NULL value or else the target's. Stored natural keys
    are NOT NULL, so keys match by plain equality: the join then reuses the
    batch reduction's hash partitioning (a NULL-safe match rewrites the
    join keys and costs one more shuffle per side; ``null_safe=True``).
    """
    keep_if_null = list(keep_if_null)
    b = reduce_batch(batch, keys, order, overwrite, keep_if_null).withColumn("_in_b", F.lit(True))
    t = target.select(*keys, *overwrite, *keep_if_null)
    ta, ba = t.alias("t"), b.alias("b")
    eq = (lambda a, b: a.eqNullSafe(b)) if null_safe else (lambda a, b: a == b)
    cond = reduce(lambda a, c: a & c, [eq(F.col(f"t.{k}"), F.col(f"b.{k}")) for k in keys])
    j = ta.join(ba, cond, "full_outer")
    in_b = F.col("b._in_b").isNotNull()
    cols = [F.when(in_b, F.col(f"b.{k}")).otherwise(F.col(f"t.{k}")).alias(k) for k in keys]
    cols += [F.when(in_b, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in overwrite]
    cols += [F.coalesce(F.col(f"b.{c}"), F.col(f"t.{c}")).alias(c) for c in keep_if_null]
    return j.select(*cols)


def replace(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | str) -> DataFrame:
    """K2 / K3: every measure of a batch key is overwritten; a measure the batch
    lacks becomes NULL. Target rows of other keys are kept unchanged."""
    cols = target.columns
    order_cols = [order] if isinstance(order, str) else list(order)
    b = last_per_key(batch.select(*[c for c in batch.columns if c in cols or c in order_cols]),
                     keys, order, keep_order=True)
    b = b.select(*[(F.col(c) if c in b.columns else F.lit(None)).cast(target.schema[c].dataType)
                   .alias(c) for c in cols])
    kept = target.join(b.select(*keys), keys, "left_anti").select(*cols)
    return kept.unionByName(b)


def publish(spark: SparkSession, df: DataFrame, path: str, partition_by: list[str] | None = None,
            stage: bool = True) -> str:
    """Sink: write ``df`` as parquet, overwriting only the partitions it touches.

    When ``df`` was computed from ``path`` itself, it is first staged to a
    fresh folder under the checkpoint directory (never read and overwrite one
    path in one plan), then the staged copy replaces the touched partitions.
    """
    out, tmp = df, None
    if stage:
        tmp = scratch_path(spark, "stage")
        df.write.mode("overwrite").parquet(tmp)
        out = spark.read.schema(df.schema).parquet(tmp)
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    if tmp:
        drop_path(spark, tmp)
    return path


def _touched_partitions(target: DataFrame, batch: DataFrame, partition_by: list[str]) -> DataFrame:
    """Restrict the stored table to the partitions the (staged) batch touches.

    The range of the first partition column prunes directories at planning
    time; the semi-join on all of them prunes the rest when it runs (dynamic
    partition pruning needs the range filter on the batch's side).
    """
    first = partition_by[0]
    lo, hi = batch.agg(F.min(first), F.max(first)).first()
    if lo is None:
        return target.limit(0)
    inside = F.col(first).between(F.lit(lo), F.lit(hi))
    touched = batch.filter(inside).select(*partition_by).distinct()
    return target.filter(inside).join(touched, partition_by, "left_semi")


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a parquet table can be read at ``path`` (any file system)."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def _stored_schema(spark: SparkSession, path: str, batch: DataFrame,
                   declared: T.StructType | None) -> T.StructType:
    """Columns of the stored table: the declared schema, or what is stored plus what the batch adds.

    Types of columns in the batch are the batch's (partition values are not
    re-inferred as numbers).
    """
    known = {f.name: f.dataType for f in batch.schema.fields}
    if declared is not None:
        return T.StructType([T.StructField(f.name, known.get(f.name, f.dataType)) for f in declared.fields])
    stored = spark.read.parquet(path).schema.fields
    fields = [T.StructField(f.name, known.get(f.name, f.dataType)) for f in stored]
    names = {f.name for f in stored}
    return T.StructType(fields + [T.StructField(n, t) for n, t in known.items() if n not in names])


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, keys: list[str],
                 order: list[str] | str, overwrite: list[str], keep_if_null: list[str] = (),
                 partition_by: list[str] | None = None, mode: str = "merge",
                 schema: T.StructType | None = None) -> str:
    """Upsert a batch into the stored table at ``path`` (K1-K3 + sink).

    The reduced batch is staged once; partition pruning and the merge both
    read that copy, which is removed afterwards. Only partitions the batch
    touches are read and rewritten, with every stored column (``schema``, or
    the columns found): a measure the batch lacks is NULL for its own keys in
    ``replace`` mode, stays as stored in ``merge`` mode, and never changes for
    other keys. An empty batch is a no-op on the data.
    """
    exists = table_exists(spark, path)
    have = set(batch.columns)
    overwrite = [c for c in overwrite if c in have]
    keep_if_null = [c for c in keep_if_null if c in have]
    tmp = scratch_path(spark, "batch")
    if mode == "merge":
        reduced = reduce_batch(batch, keys, order, overwrite, keep_if_null)
    else:
        order_cols = [order] if isinstance(order, str) else list(order)
        reduced = last_per_key(batch.select(*keys, *overwrite, *keep_if_null, *[
            c for c in order_cols if c not in keys + overwrite + keep_if_null]), keys, order)
    reduced.write.parquet(tmp)
    reduced = spark.read.schema(reduced.schema).parquet(tmp)
    if exists:
        stored = _stored_schema(spark, path, reduced, schema)
        target = spark.read.schema(stored).parquet(path)
        if partition_by:
            target = _touched_partitions(target, reduced, partition_by)
    else:
        known = {f.name for f in (schema.fields if schema else [])}
        stored = T.StructType((list(schema.fields) if schema else []) + [
            f for f in reduced.schema.fields if f.name not in known])
        target = spark.createDataFrame([], stored)
    if mode == "merge":
        merged = _merge_reduced(target, reduced, keys, overwrite, keep_if_null)
    else:
        merged = replace(target, reduced, keys, keys[0])
    publish(spark, merged, path, partition_by, stage=exists)
    drop_path(spark, tmp)
    return path


def _merge_reduced(target: DataFrame, reduced: DataFrame, keys: list[str], overwrite: list[str],
                   keep_if_null: list[str]) -> DataFrame:
    """``merge`` for a batch that is already one row per key; other target columns stay."""
    rest = [c for c in target.columns if c not in keys + overwrite + keep_if_null]
    b = reduced.withColumn("_in_b", F.lit(True)).alias("b")
    t = target.alias("t")
    j = t.join(b, reduce(lambda a, c: a & c, [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys]), "full_outer")
    in_b = F.col("b._in_b").isNotNull()
    cols = [F.when(in_b, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in keys + overwrite]
    cols += [F.coalesce(F.col(f"b.{c}"), F.col(f"t.{c}")).alias(c) for c in keep_if_null]
    return j.select(*cols, *[F.col(f"t.{c}").alias(c) for c in rest]).select(*target.columns)
