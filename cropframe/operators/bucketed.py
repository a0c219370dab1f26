"""Bucketed stored tables: a merge that shuffles the batch only (K1-K3).

The stored table is written hashed by its key into a fixed number of buckets,
sorted inside each. A batch dealt to as many partitions by the same hash then
meets the stored rows where they lie: the plan's only exchange is the batch's,
however large the stored table is. A merge writes the next version of the table
beside the last one, so readers keep a whole table and a failed run leaves no
half of one; versions before the last are dropped.

Tables are catalog tables (their bucketing is the catalog's to remember), in
the session's warehouse or, with ``location``, in a folder a version below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cropframe.operators.upsert import last_per_key, merge


def _versions(spark: SparkSession, table: str) -> list[int]:
    mark = f"{table.split('.')[-1]}_v".lower()
    names = [t.name.lower() for t in spark.catalog.listTables(pattern=f"{mark}*") if not t.isTemporary]
    return sorted(int(n[len(mark):]) for n in names if n.startswith(mark) and n[len(mark):].isdigit())


def latest(spark: SparkSession, table: str) -> str | None:
    """Name of the newest version of ``table``, None if it was never written."""
    found = _versions(spark, table)
    return f"{table}_v{found[-1]}" if found else None


def write_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, location: str | None = None) -> str:
    """Store ``df`` as the next version of ``table``; its rows should be dealt by key already (one file a bucket)."""
    spark = df.sparkSession
    found = _versions(spark, table)
    name = f"{table}_v{(found[-1] if found else 0) + 1}"
    w = df.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").mode("errorifexists")
    (w.option("path", f"{location}/{name}") if location else w).saveAsTable(name)
    for old in found[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS {table}_v{old}")
    return name


def merged(spark: SparkSession, table: str, batch: DataFrame, keys: list[str], order: list[str] | str,
           overwrite: list[str], keep_if_null: list[str] = (), buckets: int = 200) -> DataFrame:
    """The stored table with ``batch`` merged into it by key (see ``upsert.merge``), not yet written."""
    dealt = batch.repartition(buckets, *keys)
    return merge(spark.table(latest(spark, table)), dealt, keys, order, overwrite, keep_if_null)


def upsert_bucketed(batch: DataFrame, table: str, keys: list[str], order: list[str] | str, overwrite: list[str],
                    keep_if_null: list[str] = (), buckets: int = 200, location: str | None = None) -> str:
    """Merge ``batch`` into ``table`` (created on the first call) and store the result; returns the version's name.

    ``buckets`` has to stay the same for a table: another number costs one
    shuffle of the stored side and gives the table its new number.
    """
    spark = batch.sparkSession
    cols = [*keys, *overwrite, *keep_if_null]
    order_cols = [order] if isinstance(order, str) else list(order)
    batch = batch.select(*dict.fromkeys([*cols, *order_cols]))
    if latest(spark, table) is None:
        dealt = batch.repartition(buckets, *keys)
        first = last_per_key(dealt, keys, order, keep_order=True).select(*cols)
        return write_bucketed(first, table, keys, buckets, location)
    whole = merged(spark, table, batch, keys, order, overwrite, keep_if_null, buckets)
    return write_bucketed(whole, table, keys, buckets, location)
