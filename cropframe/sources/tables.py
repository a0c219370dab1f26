"""Stored-table scans (S8) and the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.functions import nan_to_null
from cropframe.sources import schemas


def read_table(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A stored table as parquet, projected to its final declared schema.

    Old extracts may still carry dropped columns (month, silt_pct, ...); the
    explicit projection keeps only the final schema, and columns a file lacks
    come back NULL.
    """
    if table is None:
        df = spark.read.parquet(path)
        return df.select(*[_clean(df, f) for f in df.schema.fields])
    return _project(spark.read.parquet(path), table)


def read_table_jdbc(spark: SparkSession, url: str, table: str, partition_column: str = "year",
                    lower: int = 1980, upper: int = 2024, partitions: int = 45,
                    properties: dict | None = None) -> DataFrame:
    """S8 over a relational store: a parallel JDBC scan split on a numeric column.

    Each of ``partitions`` tasks reads one range of ``partition_column``
    (the stored tables' year, or a surrogate id), instead of one task
    reading the whole table; filters on the result are pushed to the
    database. Not exercised by the tests: no database may run here.
    """
    df = spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                         upperBound=upper, numPartitions=partitions,
                         properties=properties or {})
    return _project(df, table)


def _project(df: DataFrame, table: str) -> DataFrame:
    """Explicit projection to the final stored schema (dropped columns ignored,
    columns an old extract lacks come back NULL)."""
    schema = schemas.STORED[table]
    present = set(df.columns)
    return df.select(*[
        _clean(df, f) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def _clean(df: DataFrame, field: T.StructField):
    """The column in its stored type, NaN as NULL."""
    c = nan_to_null(field.name) if isinstance(df.schema[field.name].dataType, (T.DoubleType, T.FloatType)) \
        else F.col(field.name)
    return c.cast(field.dataType).alias(field.name)


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
