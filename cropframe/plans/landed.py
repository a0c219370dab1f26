"""Queries over landed files: the given tables written out in the services' formats, and read back by the sources.

Files go to new folders under the shared scratch folder. Each query runs a
source (S1, S3-S6) or a sink (K5-K7) end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.functions import round_doubles
from cropframe.operators import clean, explain, model, season, soil
from cropframe.plans import stand_ins as S
from cropframe.session import scratch_path
from cropframe.sources import driver_table
from cropframe.sources.files import (decode_response_table, read_daily_csv, read_daily_grid, read_soil_tables,
                                     read_yield_csv)
from cropframe.streaming.upsert_stream import stream_upsert

DIGITS = S.DIGITS


def _yield_rows(o: DataFrame, value) -> DataFrame:
    """Orders as the survey's CSV rows: some of another item, some without one, some values with a thousands comma."""
    key = F.col("o_orderkey")
    item = F.when(key % 7 == 0, F.lit(None)).when(key % 5 == 0, F.lit("ACRES PLANTED")).otherwise(
        F.concat(F.lower("o_orderpriority"), F.lit(" - Yield, measured in BU / ACRE")))
    return o.select(
        F.concat(F.lit(" S"), F.col("o_custkey") % 3, F.lit(" ")).alias("State"), F.concat(F.lit("C"), "o_custkey").alias("County"),
        F.year("o_orderdate").cast("string").alias("Year"), F.col("o_orderpriority").alias("Commodity"), item.alias("Data Item"),
        value.alias("Value"), F.concat(F.lit("D"), F.col("o_custkey") % 10).alias("Ag District"),
        F.when(key % 4 > 0, (F.col("o_custkey") % 100).cast("string")).alias("County ANSI"))


def q_yield_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield CSV files written from the orders, read back and cleaned."""
    path = scratch_path(spark, "yield-csv")
    value = F.when(F.col("o_orderkey") % 3 == 0, F.format_number("o_totalprice", 2)).otherwise(
        F.format_string("%.2f", "o_totalprice"))
    rows = _yield_rows(driver_table(spark, sf_dir, "orders"), value)
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    out = clean.clean_yield_csv(read_yield_csv(spark, path), 1993, 1997)
    return round_doubles(out.select("year", "state", "county", "crop", "value", "unit", "district", "county_ansi"), DIGITS)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by supplier nation as daily rows."""
    li = driver_table(spark, sf_dir, "lineitem")
    s = driver_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n, r = driver_table(spark, sf_dir, "nation"), driver_table(spark, sf_dir, "region")
    return (li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey).withColumnsRenamed({"n_name": "county", "r_name": "state"})
            .withColumn("year", F.year("l_shipdate")))


def q_daily_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid rows with a day of the year, read back and summed up by season."""
    path = scratch_path(spark, "daily-grid")
    d = _daily(spark, sf_dir)
    d.select("county", "state", "year", F.dayofyear("l_shipdate").alias("yday"), F.col("l_quantity").alias("tmax"),
             F.col("l_tax").alias("tmin"), F.col("l_extendedprice").alias("prcp"),
             F.when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_discount")).alias("vp"),
             F.col("l_tax").alias("srad")).write.parquet(path)
    out = season.annual_features(read_daily_grid(spark, path), ["county", "state"], "date", "tmax", "tmin",
                                 sums={"precipitation": "prcp"}, means={"vp": "vp", "srad": "srad"})
    return round_doubles(out, DIGITS)


def q_daily_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV folder per county and year, read back by one scan."""
    path = scratch_path(spark, "daily-csv")
    d = _daily(spark, sf_dir).select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_quantity").alias("max_air_temperature"),
        F.col("l_tax").alias("min_air_temperature"), (F.col("l_quantity") / 2).alias("avg_air_temperature"),
        F.col("l_extendedprice").alias("precipitation"), "state", "county", "year")
    d.repartition("state", "county", "year").write.option("header", True).partitionBy("state", "county", "year").csv(path)
    out = season.annual_features(read_daily_csv(spark, path), ["county", "state"], "date", "max_air_temperature",
                                 "min_air_temperature", sums={"precipitation": "precipitation"}, temp_mean="avg_air_temperature")
    return round_doubles(out, DIGITS)


def q_soil_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five survey tables as CSV, read back and weighted to the county."""
    base = scratch_path(spark, "soil-tables")
    n, r = driver_table(spark, sf_dir, "nation"), driver_table(spark, sf_dir, "region")
    li, p = driver_table(spark, sf_dir, "lineitem"), driver_table(spark, sf_dir, "part")
    unit = F.concat_ws("-", "l_suppkey", "l_partkey")
    units = li.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("acres"))
    parts = units.join(p, F.col("l_partkey") == F.col("p_partkey"))
    tables = {
        "sacatalog": n.join(r, n.n_regionkey == r.r_regionkey).select(
            F.col("n_nationkey").alias("areasymbol"), F.concat("n_name", F.lit(" County, "), "r_name").alias("areaname"),
            *[F.lit("0").alias(c) for c in ("mbrminx", "mbrminy", "mbrmaxx", "mbrmaxy")]),
        "legend": driver_table(spark, sf_dir, "supplier").select(
            F.col("s_nationkey").alias("areasymbol"), F.col("s_suppkey").alias("lkey")),
        "mapunit": units.select(F.col("l_suppkey").alias("lkey"), unit.alias("mukey"), F.col("acres").alias("muacres")),
        "component": parts.select(unit.alias("mukey"), unit.alias("cokey"), F.when(
            F.col("p_partkey") % 4 == 0, "Taxadjunct").otherwise("Series").alias("compkind"), F.col("p_size").alias("comppct_r")),
        "chorizon": parts.select(
            unit.alias("cokey"), F.when(F.col("p_partkey") % 3 == 0, "B").otherwise("A").alias("hzname"),
            (F.col("p_size") % 14).alias("ph1to1h2o_r"), (F.col("p_size") % 20).alias("cec7_r"),
            (F.col("p_partkey") % 60).alias("sandtotal_r"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey") % 30).alias("claytotal_r"),
            (F.col("p_size") % 5).alias("om_r"))}
    for name, t in tables.items():
        t.write.option("header", True).csv(f"{base}/{name}")
    return round_doubles(soil.county_soil(read_soil_tables(spark, base)), DIGITS)


def q_response_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response object per order, its header in one of two orders, landed as JSON text and decoded."""
    path = scratch_path(spark, "responses")
    li = driver_table(spark, sf_dir, "lineitem")
    odd = F.col("l_orderkey") % 2 == 1
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    rows = li.groupBy("l_orderkey").agg(F.collect_list(F.when(odd, F.array(q, n)).otherwise(F.array(n, q))).alias("rows"))
    head = F.when(odd, F.array(F.lit("quantity"), F.lit("line"))).otherwise(F.array(F.lit("line"), F.lit("quantity")))
    objects = rows.select("l_orderkey", F.to_json(F.struct(F.concat(F.array(head), "rows").alias("Table"))).alias("Table"))
    objects.write.json(path)
    landed = spark.read.schema("l_orderkey long, Table string").json(path)
    return decode_response_table(landed, ["line", "quantity", "unit"], keep=["l_orderkey"])


def q_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: two landings of the yields, each picked up by the stream; the later one wins and lacks some codes."""
    landing, store = scratch_path(spark, "landing"), scratch_path(spark, "stream-store")
    y = S.yields_stand_in(spark, sf_dir)

    def land(rows: DataFrame, value, code) -> None:
        rows.select(F.col("state").alias("State"), F.col("county").alias("County"), F.col("year").cast("string").alias("Year"),
                    F.col("crop").alias("Commodity"), F.lit("YIELD").alias("Data Item"), F.format_string("%.3f", value).alias("Value"),
                    F.col("district").alias("Ag District"), code.alias("County ANSI")).coalesce(1).write.mode("append").option(
            "header", True).csv(landing)
        stream_upsert(spark, landing, store).awaitTermination()

    y = model.materialize(y.withColumn("value", F.round("value", 1)))
    land(y, F.col("value"), F.col("county_ansi"))
    land(y.filter(F.col("year") % 2 == 0), F.col("value") * 2, F.when(F.length("county") % 2 == 0, F.col("county_ansi")))
    out = spark.read.parquet(f"{store}/yields")
    return round_doubles(out.select("year", "state", "district", "county", "county_ansi", "crop", "value", "unit"), DIGITS)


def q_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: explanations written by model and run, and read back."""
    path = scratch_path(spark, "explanations")
    explain.write_explanations(S.q_linear_shap(spark, sf_dir), path, "lr", "2024-01-01T00:00")
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "feature", "value", "shap", "base", "model",
                                           F.col("run_ts").cast("string").alias("run_ts"))


def q_saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted line saved, read again and applied to the frame."""
    from pyspark.ml import PipelineModel
    f = S.frame_table(spark, sf_dir)
    path = model.save(model.fit(f, S.FRAME_KEY, ["gdd"], "yield"), scratch_path(spark, "model"))
    return S.round_fixed(model.score(PipelineModel.load(path), f).select(*S.FRAME_KEY, "prediction"), 2)


QUERIES = {
    "q_yield_csv": q_yield_csv,
    "q_daily_grid": q_daily_grid,
    "q_daily_csv": q_daily_csv,
    "q_soil_tables": q_soil_tables,
    "q_response_table": q_response_table,
    "q_stream_upsert": q_stream_upsert,
    "q_explanations": q_explanations,
    "q_saved_model": q_saved_model,
}
