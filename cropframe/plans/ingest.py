"""Bulk ingest (K4) and yield back-fill (E-2) as set-wise Spark jobs.

The reference loops over (county, state) groups and fetches each one; here
each of the three pipelines handles every county at once: one scan of the
landed files, one shuffle by natural key, one upsert per stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.operators import clean, gaps, query, season, soil, upsert
from cropframe.sources import (read_daily_grid, read_soil_tables, read_yield_csv,
                               read_yield_json, schemas)
from cropframe.sources.tables import read_table

WEATHER_MEASURES = ["avg_temp", "precipitation", "vp", "srad", "gdd"]
SOIL_MEASURES = ["ph", "organic_matter", "sand_pct", "clay_pct"]
YIELD_ORDER = ["src_file", "src_block", "src_row"]


def year_spans(yield_csv: DataFrame) -> DataFrame:
    """Year span per (county, state) of the landed CSV (keys trimmed)."""
    df = yield_csv.select(F.col("County").alias("county"), F.col("State").alias("state"),
                          F.col("Year").try_cast("int").alias("year"))
    return query.year_span(df, ["county", "state"])


def weather_for_spans(daily: DataFrame, spans: DataFrame) -> DataFrame:
    """G2 over the daily grid rows of each county's year span.

    The span table has one row per county; the semi-join keeps only the
    daily rows inside the span (the equi-part on county/state lets Spark
    hash both sides, the span is a post-filter).
    """
    d = daily.join(spans, ["county", "state"], "inner").filter(
        F.col("year").between(F.col("start_year"), F.col("end_year")))
    w = season.annual_features(d, keys=["county", "state"], date="date", tmax="tmax", tmin="tmin",
                               sums={"precipitation": "prcp"},
                               means={"vp": "vp", "srad": "srad"})
    return w.select("county", "state", "year", *WEATHER_MEASURES)


def soil_for_spans(tables: dict[str, DataFrame], spans: DataFrame) -> DataFrame:
    """G1 per county of the CSV (catalog area '<county> County, <state>')."""
    feats = soil.county_soil(tables)
    keys = spans.select("county", "state").distinct()
    return (feats.join(keys.select(F.lower("county").alias("_c"), F.lower("state").alias("_s"),
                                   "county", "state"),
                       (F.lower(feats.county) == F.col("_c")) & (F.lower(feats.state) == F.col("_s")))
            .select(keys.county, keys.state, *SOIL_MEASURES))


def bulk_ingest(spark: SparkSession, yield_csv_path: str, daily_path: str, soil_base: str,
                store: str, daily_fmt: str = "parquet", soil_fmt: str = "csv",
                dry_run: bool = False, yield_json_path: str | None = None) -> dict[str, object]:
    """K4: land all three tables for every county named in the yield CSV.

    The CSV names the counties and their year spans. Yield rows come from
    the landed service records under ``yield_json_path`` when given (the
    reference's API path), else from the CSV itself (its fallback).
    ``dry_run`` returns the per-county plan (spans) without writing.
    Tables are stored under ``store``/{yields,weather,soil}, partitioned by
    state so later scans and upserts prune to the states they touch.
    """
    raw = read_yield_csv(spark, yield_csv_path)
    spans = year_spans(raw)
    if dry_run:
        return {"plan": spans}
    tables = read_soil_tables(spark, soil_base, soil_fmt)
    s = soil_for_spans(tables, spans).withColumn("_o", F.lit(0))
    upsert.upsert_table(spark, f"{store}/soil", s, schemas.SOIL_KEY, "_o", SOIL_MEASURES,
                        partition_by=["state"], mode="replace", schema=schemas.SOIL)
    w = weather_for_spans(read_daily_grid(spark, daily_path, daily_fmt), spans).withColumn(
        "_o", F.lit(0))
    upsert.upsert_table(spark, f"{store}/weather", w, schemas.WEATHER_KEY, "_o", WEATHER_MEASURES,
                        partition_by=["state"], mode="replace", schema=schemas.WEATHER)
    if yield_json_path:
        recs = clean.clean_yield_json(read_yield_json(spark, yield_json_path))
        # A record answers one (county, state) request of the CSV; rows are
        # stored under the requested names, as the per-county fetch did.
        req = spans.select(F.col("county").alias("_rc"), F.col("state").alias("_rs"), "start_year", "end_year")
        y = (recs.join(req, (F.upper(F.trim("county")) == F.upper(F.trim("_rc")))
                       & (F.upper(F.trim("state")) == F.upper(F.trim("_rs"))))
             .filter(F.col("year").between(F.col("start_year"), F.col("end_year")))
             .withColumn("county", F.col("_rc")).withColumn("state", F.col("_rs"))
             .drop("_rc", "_rs", "start_year", "end_year").withColumn("src_block", F.lit(0).cast("long"))
             .filter(F.col("crop").isNotNull()))
    else:
        y = clean.clean_yield_csv(raw, requests=spans.select("county", "state"))
    upsert.upsert_table(spark, f"{store}/yields", y, schemas.YIELD_KEY, YIELD_ORDER,
                        overwrite=["value", "unit"], keep_if_null=["district", "county_ansi"],
                        partition_by=["state"], schema=schemas.YIELDS)
    return {"plan": spans, "store": store}


def backfill_plan(stored_yields: DataFrame, state: str | None, crop: str | None,
                  start_year: int | None, end_year: int | None,
                  catalog_counties: DataFrame | None = None) -> DataFrame:
    """E-2 steps D1 -> J5 -> W1: fetch ranges per (county, state, crop).

    With no stored rows for the state, every catalog county misses the
    whole range (Q2).
    """
    fallback = None
    if catalog_counties is not None:
        fallback = catalog_counties.select("county", F.lit(state).alias("state"),
                                           F.lit(crop).cast("string").alias("crop"))
    return gaps.fetch_plan(stored_yields, ["county", "state", "crop"], start_year, end_year,
                           equals={"state": state, "crop": crop}, fallback_keys=fallback)


def backfill(spark: SparkSession, store: str, landed_yields: DataFrame, state=None, crop=None,
             start_year=None, end_year=None, catalog: DataFrame | None = None) -> DataFrame:
    """E-2: upsert the landed rows that fill missing years, then the filtered scan (F1).

    ``landed_yields`` are cleaned yield rows (from S1 or S2); only rows of
    missing (county, state, year) are kept (J7), and only the asked crop
    when one is given. State and crop are normalised first, as for the scan.
    A state without stored rows is filled for every county of ``catalog``
    (areaname), as the reference asks the service for each (Q2).
    """
    path = f"{store}/yields"
    if upsert.table_exists(spark, path):
        stored = read_table(spark, path, "yields")
    else:
        stored = spark.createDataFrame([], schemas.YIELDS)
    asked = query.normalise_params(state=state, crop=crop)
    state, crop = asked["state"], asked["crop"]
    # counties are named as the landed rows name them
    counties = None
    if catalog is not None and state is not None:
        known = clean.counties_of_state(catalog, state).select(F.upper(F.trim("county")).alias("_c"))
        counties = landed_yields.filter(F.col("state") == state).select("county").distinct().join(
            known, F.upper(F.trim("county")) == F.col("_c"), "left_semi")
    plan = backfill_plan(stored, state, crop, start_year, end_year, counties)
    fill = gaps.keep_missing(landed_yields, plan, ["county", "state"], crop=crop)
    upsert.upsert_table(spark, path, fill, schemas.YIELD_KEY, YIELD_ORDER, ["value", "unit"],
                        ["district", "county_ansi"], partition_by=["state"], schema=schemas.YIELDS)
    return query.yield_query(read_table(spark, path, "yields"), state, crop, start_year, end_year)


def main(argv: list[str] | None = None) -> None:
    """Command line: ``python -m cropframe.plans.ingest --yield-csv ... --store ...``.

    A dry run (``--dry-run`` or a non-empty DRY_RUN other than "0") writes the
    whole per-county plan as a table under ``<store>/plan`` and nothing else.
    """
    import argparse
    import os

    from cropframe.session import job_session
    ap = argparse.ArgumentParser(description="Bulk ingest of yield, weather and soil tables")
    ap.add_argument("--yield-csv", required=True)
    ap.add_argument("--yield-json")
    ap.add_argument("--daily", required=True)
    ap.add_argument("--soil", required=True)
    ap.add_argument("--store", required=True)
    ap.add_argument("--daily-format", default="parquet")
    ap.add_argument("--soil-format", default="csv")
    ap.add_argument("--dry-run", action="store_true")
    a = ap.parse_args(argv)
    env = os.environ.get("DRY_RUN", "")
    dry = a.dry_run or bool(env and env != "0")
    spark = job_session("cropframe-ingest")
    out = bulk_ingest(spark, a.yield_csv, a.daily, a.soil, a.store, a.daily_format,
                      a.soil_format, dry_run=dry, yield_json_path=a.yield_json)
    if dry:
        out["plan"].orderBy("state", "county").write.mode("overwrite").option("header", True).csv(f"{a.store}/plan")


if __name__ == "__main__":
    main()
