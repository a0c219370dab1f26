"""Landed-file scans (S1-S7, D7). Each reads every county at once, never a file per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.functions import county_name, day_of_year_date, nan_to_null
from cropframe.sources import schemas


def read_yield_csv(spark: SparkSession, path: str) -> DataFrame:
    """The yield CSV, all columns as text, plus the row's position in its file.

    ``src_order`` (file name, byte offset of the split, row within split) makes
    "later rows win" deterministic for the upsert.
    """
    df = (spark.read.schema(schemas.YIELD_CSV).option("header", True)
          .option("mode", "PERMISSIVE").csv(path))
    return _with_src_order(df)


def read_yield_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed response objects -> one row per record under ``data``.

    ``has_commodity`` tells whether the file carries commodity names at all;
    files without them keep only year and value (F6). ``has_<column>`` tells
    the same of the other optional columns.
    """
    raw = spark.read.schema(schemas.YIELD_JSON).option("multiLine", True).json(path)
    return explode_records(raw.select(F.col("_metadata.file_path").alias("src_file"), "data"), ["src_file"])


def explode_records(raw: DataFrame, keep: list[str]) -> DataFrame:
    """One row per record of response objects; which columns a response carries is
    read off its array before the explode, so nothing is shuffled.

    Records that the service request would not return (another statistic,
    unit, level, ...) are dropped; a field that a record lacks does not judge.
    """
    def carries(c: str):
        return F.exists("data", lambda r: r[c].isNotNull())

    has = [carries(c).alias("has_commodity" if c == "commodity_desc" else f"has_{c}")
           for c in schemas.OPTIONAL_RECORD]
    df = raw.select(*keep, *has, F.posexplode("data").alias("src_row", "rec"))
    for c, value in schemas.SERVICE_FILTER.items():
        df = df.filter(F.coalesce(F.col(f"rec.{c}") == value, F.lit(True)))
    names = [f.name for f in schemas.YIELD_RECORD.fields
             if f.name not in schemas.SERVICE_FILTER or f.name in schemas.OPTIONAL_RECORD]
    return df.select(*keep, "src_row", *[F.col(f"rec.{n}").alias(n) for n in names],
                     "has_commodity", *[f"has_{c}" for c in schemas.OPTIONAL_RECORD[1:]])


def read_daily_grid(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: daily grid rows of all counties; adds the calendar date."""
    df = spark.read.schema(schemas.DAILY_GRID).format(fmt).load(path)
    measures = ["tmax", "tmin", "prcp", "vp", "srad"]
    return df.select("county", "state", "year", "yday",
                     day_of_year_date("year", "yday").alias("date"),
                     *[nan_to_null(m).alias(m) for m in measures])


def read_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per county-year CSV files landed as ``.../state=S/county=C/year=Y/*.csv``.

    county, state and year come from the landing path through partition
    discovery, so one scan reads every county.
    """
    schema = T.StructType(schemas.DAILY_CSV.fields + [
        T.StructField("state", T.StringType()), T.StructField("county", T.StringType()),
        T.StructField("year", T.IntegerType())])
    df = (spark.read.schema(schema).option("header", True).option("basePath", path)
          .csv(path))
    nums = ["max_air_temperature", "min_air_temperature", "avg_air_temperature", "precipitation"]
    return df.select("state", "county", "year", F.to_date("date").alias("date"),
                     *[nan_to_null(c).alias(c) for c in nums])


def read_soil_tables(spark: SparkSession, base: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """The five soil-survey tables, every column as text (parsed later)."""
    out = {}
    for name, cols in schemas.SOIL_TABLES.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        r = spark.read.schema(schema)
        if fmt == "csv":
            r = r.option("header", True)
        out[name] = r.format(fmt).load(f"{base}/{name}")
    return out


def decode_response_table(df: DataFrame, columns: list[str], table_col: str = "Table",
                          keep: list[str] | None = None) -> DataFrame:
    """``{"Table": [[header], [row], ...]}`` -> one row per data row.

    ``table_col`` may hold the parsed array or JSON text. Columns are found by
    name in the header, so their order does not matter; a missing column or a
    short row gives NULL; a header-only or missing table gives no rows.
    """
    t = F.col(table_col)
    if isinstance(df.schema[table_col].dataType, T.StringType):
        t = F.from_json(t, schemas.RESPONSE_TABLE)["Table"]
    keep = keep or []
    staged = df.select(*keep, t.alias("_t")).select(
        *keep, F.element_at("_t", 1).alias("_h"),
        F.explode(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0)))).alias("_r"))
    return staged.select(*keep, *[
        F.try_element_at("_r", F.nullif(F.array_position("_h", F.lit(c)), F.lit(0)).cast("int"))
        .alias(c) for c in columns])


def read_catalog(catalog: DataFrame, state: str | None = None) -> DataFrame:
    """County list of a state from the survey catalog (areaname, box columns).

    Every row is kept (Q3); the county is the text before ' County,' (C5).
    """
    df = catalog
    if state:
        df = df.filter(F.col("areaname").endswith(f", {state}"))
    return df.select("areasymbol", "areaname", county_name("areaname").alias("county"),
                     *[F.col(c) for c in ("mbrminx", "mbrminy", "mbrmaxx", "mbrmaxy")
                       if c in df.columns])


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames whose columns may differ (missing -> NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _with_src_order(df: DataFrame) -> DataFrame:
    """Source order of each row: (file, split start, row within split).

    ``monotonically_increasing_id`` encodes the partition, which is stable
    only for one scan; the pair (file, split offset) is stable across runs.
    """
    return (df.withColumn("src_file", F.col("_metadata.file_path"))
              .withColumn("src_block", F.col("_metadata.file_block_start"))
              .withColumn("src_row", F.monotonically_increasing_id()))
