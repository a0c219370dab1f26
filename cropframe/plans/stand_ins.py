"""Role bindings of the driver's TPC-H-like tables to the crop data model.

county = n_name, state = r_name, year from o_orderdate or l_shipdate,
crop = o_orderpriority. Each ``q_*`` builds a DataFrame by calling the
library operators; rounding of doubles happens only at the very end, so
results compare stably with the SQL oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.functions import round_doubles
from cropframe.functions.numeric import NUDGE
from cropframe.functions import area_name, day_of_year_date, norm_key, parse_number
from cropframe.operators import (bucketed, clean, explain, frame, gaps, knn_mi, model, phik, profile, query, regional,
                                 season, select, sketch, soil, upsert)
from cropframe.plans import ingest
from cropframe.session import scratch_path
from cropframe.sources import concat_frames, driver_table, read_catalog
from cropframe.sources.files import explode_records

DIGITS = 6


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return driver_table(spark, sf_dir, name)


# --------------------------------------------------------------------------- season
def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as daily climate: tmax=l_quantity, tmin=l_tax, prcp=l_extendedprice,
    vp=l_discount, srad=l_tax."""
    return _t(spark, sf_dir, "lineitem")


def q_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lineitem_daily(spark, sf_dir)
    out = season.annual_features(
        li, keys=["l_suppkey"], date="l_shipdate", tmax="l_quantity", tmin="l_tax",
        sums={"precipitation": "l_extendedprice"},
        means={"vp": "l_discount", "srad": "l_tax"})
    return round_doubles(out, DIGITS)



def q_season_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 + D7: two landed halves with different columns, CSV-variant temperature."""
    li = _t(spark, sf_dir, "lineitem")
    cols = ["l_suppkey", "l_shipdate", "l_quantity", "l_tax", "l_extendedprice", "l_discount"]
    first = li.filter(F.col("l_shipdate") < F.lit("1998-06-01")).select(*cols)
    second = li.filter(F.col("l_shipdate") >= F.lit("1998-06-01")).select(*cols, "l_linenumber")
    daily = concat_frames([first, second])
    out = season.annual_features(daily, keys=["l_suppkey"], date="l_shipdate",
                                 tmax="l_quantity", tmin="l_tax",
                                 sums={"precipitation": "l_extendedprice"},
                                 temp_mean="l_discount")
    return round_doubles(out, DIGITS)


SEASONS = {"spring": (3, 5), "summer": (6, 8), "growing": (5, 9), "winter_start": (1, 2)}


def q_season_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precipitation over several named, overlapping month windows."""
    out = season.season_table(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate",
                              "l_extendedprice", SEASONS)
    return round_doubles(out, DIGITS)


def q_cum_gdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 on events: one temperature reading per event, whole-year season."""
    ev = _t(spark, sf_dir, "events")
    out = season.cumulative_gdd(ev, keys=["user_id"], date="ts", tmax="value", tmin="value",
                                months=(1, 12))
    return round_doubles(out, DIGITS)


# --------------------------------------------------------------------------- soil
SOIL_BRANDS = ["Brand#1", "Brand#2", "Brand#3"]


def soil_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > supplier > lineitem > part as the five survey tables.

    kind = l_returnflag 'N', horizons = three brands, weight =
    l_quantity / 100 * p_retailprice; one row per (state, county).
    """
    region = _t(spark, sf_dir, "region")
    nation = _t(spark, sf_dir, "nation")
    supplier = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = (_t(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "N")
          .select("l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax"))
    part = (_t(spark, sf_dir, "part").filter(F.col("p_brand").isin(SOIL_BRANDS))
            .select("p_partkey", "p_retailprice", "p_size"))
    rows = soil.chain([region, nation, supplier, li, part],
                      [("r_regionkey", "n_regionkey"), ("n_nationkey", "s_nationkey"),
                       ("s_suppkey", "l_suppkey"), ("l_partkey", "p_partkey")])
    rows = rows.select(F.col("r_name").alias("state"), F.col("n_name").alias("county"), "*")
    return soil.weighted_mean(
        rows, ["state", "county"],
        {"ph": "l_discount", "organic_matter": "l_tax", "sand_pct": "l_quantity",
         "clay_pct": "p_size"},
        soil.component_acres("l_quantity", "p_retailprice"))


def q_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(soil_stand_in(spark, sf_dir), DIGITS)


def q_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    out = soil.texture_fractions(li, sand="l_quantity", clay=F.col("l_discount") * 100,
                                 silt=F.col("l_tax") * 100,
                                 keep=["l_orderkey", "l_linenumber"])
    return round_doubles(out, DIGITS)


# --------------------------------------------------------------------------- frame
def yields_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders by (year, nation, region, priority) as the stored yields table."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority",
                                           "o_totalprice")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
          .join(r, n.n_regionkey == r.r_regionkey))
    g = j.groupBy(F.year("o_orderdate").alias("year"), F.col("r_name").alias("state"),
                  F.col("n_name").alias("county"), F.col("n_nationkey"),
                  F.col("o_orderpriority").alias("crop")).agg(
        F.avg("o_totalprice").alias("value"))
    return g.select("year", "state",
                    F.concat(F.lit("AD"), F.substring("county", -1, 1)).alias("district"),
                    "county", F.col("n_nationkey").cast("string").alias("county_ansi"),
                    "crop", "value", F.lit("BU / ACRE").alias("unit"))


def weather_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by supplier nation and ship year as the stored weather table."""
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity",
                                              "l_tax", "l_extendedprice", "l_discount")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    daily = (li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
               .join(r, n.n_regionkey == r.r_regionkey)
               .select(F.col("r_name").alias("state"), F.col("n_name").alias("county"),
                       "l_shipdate", "l_quantity", "l_tax", "l_extendedprice", "l_discount"))
    w = season.annual_features(daily, keys=["state", "county"], date="l_shipdate",
                               tmax="l_quantity", tmin="l_tax",
                               sums={"precipitation": "l_extendedprice"},
                               means={"vp": "l_discount", "srad": "l_tax"})
    return w.select("county", "state", "year", "avg_temp", "precipitation", "vp", "srad", "gdd")


def stand_in_tables(spark: SparkSession, sf_dir: str):
    return (yields_stand_in(spark, sf_dir), weather_stand_in(spark, sf_dir),
            soil_stand_in(spark, sf_dir))


def q_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, w, s = stand_in_tables(spark, sf_dir)
    return round_doubles(frame.build_frame(y, w, s), DIGITS)


def keyed_tables(spark: SparkSession, sf_dir: str):
    """Yields by customer number, weather by supplier number, soil by part number: sides that differ by themselves."""
    number = lambda c: F.concat(F.lit("C"), F.col(c))
    o = _t(spark, sf_dir, "orders")
    y = o.groupBy(F.year("o_orderdate").alias("year"), "o_custkey", F.col("o_orderpriority").alias("crop")).agg(
        F.avg("o_totalprice").alias("value"))
    y = y.select("year", F.lit("ALL").alias("state"), F.concat(F.lit("AD"), F.col("o_custkey") % 10).alias("district"),
                 number("o_custkey").alias("county"), F.col("o_custkey").cast("string").alias("county_ansi"), "crop",
                 "value", F.lit("BU / ACRE").alias("unit"))
    li = _t(spark, sf_dir, "lineitem").withColumns({"state": F.lit("ALL"), "county": number("l_suppkey")})
    w = season.annual_features(li, keys=["state", "county"], date="l_shipdate", tmax="l_quantity", tmin="l_tax",
                               sums={"precipitation": "l_extendedprice"}, means={"vp": "l_discount", "srad": "l_tax"})
    w = w.select("county", "state", "year", "avg_temp", "precipitation", "vp", "srad", "gdd")
    part = _t(spark, sf_dir, "part").filter(F.col("p_brand").isin(SOIL_BRANDS)).select("p_partkey", "p_retailprice", "p_size")
    rows = li.withColumn("county", number("l_partkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    s = soil.weighted_mean(rows, ["state", "county"], {"ph": "l_discount", "organic_matter": "l_tax",
                                                       "sand_pct": "l_quantity", "clay_pct": "p_size"},
                           soil.component_acres("l_quantity", "p_retailprice"))
    return y, w, s


def q_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6 + J3: customers without a supplier of that number and year, or without a surveyed part of it."""
    return frame.diagnostics(*keyed_tables(spark, sf_dir))


def q_unmatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yield rows without a weather match."""
    return round_doubles(frame.unmatched(*keyed_tables(spark, sf_dir)), DIGITS)


def q_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, w, s = stand_in_tables(spark, sf_dir)
    f = frame.training_scope(frame.build_frame(y, w, s), ["AD1", "AD3"])
    feats = frame.feature_columns(f)
    return round_doubles(f.select("year", "state", "county", "crop", "yield", *feats), DIGITS)


def q_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, w, s = stand_in_tables(spark, sf_dir)
    f = frame.build_frame(y, w, s)
    row = query.pick_row(f, ["county", "year", "crop"], county="NATION_3", year=1997)
    return round_doubles(row, DIGITS)


def q_yield_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = yields_stand_in(spark, sf_dir)
    out = query.yield_query(y, state="america", crop="1-urgent", start_year=1996, end_year=2000)
    return round_doubles(out, DIGITS)


def q_weather_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weather_stand_in(spark, sf_dir)
    return round_doubles(query.weather_query(w, state="europe", county=None, year=1998), DIGITS)


def q_soil_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(query.soil_query(soil_stand_in(spark, sf_dir), state="asia"), DIGITS)


def q_crop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.crop_list(spark, yields_stand_in(spark, sf_dir))


def q_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.count_distinct_by(yields_stand_in(spark, sf_dir), ["county"], "year",
                                   out="n_years")


def q_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 on raw orders: year span per (county, state) of the customer's nation."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
          .join(r, n.n_regionkey == r.r_regionkey)
          .select(F.col("n_name").alias("county"), F.col("r_name").alias("state"),
                  F.year("o_orderdate").alias("year")))
    return query.year_span(j, ["county", "state"])


def q_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = yields_stand_in(spark, sf_dir)
    order = ["state", "county", "year", "crop"]
    h = query.head_rows(y, order).withColumn("part", F.lit("head"))
    t = query.tail_rows(y, order).withColumn("part", F.lit("tail"))
    return round_doubles(h.unionByName(t), DIGITS)




# --------------------------------------------------------------------------- clean
def q_clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event props text, and prices formatted with thousands separators
    parsed with (records path) and without (CSV path, rows without value dropped)."""
    ev = _t(spark, sf_dir, "events").select(
        F.lit("props").alias("source"), F.col("event_id").alias("id"),
        F.lit(None).cast("int").alias("line"),
        parse_number(F.regexp_extract("props", ":([^}]*)", 1)).alias("value"))
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.format_number("l_extendedprice", 2).alias("raw"))
    strip = li.select(F.lit("price_strip").alias("source"), F.col("l_orderkey").alias("id"),
                      F.col("l_linenumber").alias("line"),
                      parse_number("raw", strip_thousands=True).alias("value"))
    plain = li.select(F.lit("price_plain").alias("source"), F.col("l_orderkey").alias("id"),
                      F.col("l_linenumber").alias("line"), parse_number("raw").alias("value"))
    out = ev.unionByName(strip).unionByName(plain).dropna(subset=["value"])
    return round_doubles(out, DIGITS)


def q_clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed area names split back into counties."""
    n = clean.select_renamed(_t(spark, sf_dir, "nation"),
                             {"n_nationkey": "areasymbol", "n_name": "name",
                              "n_regionkey": "regionkey", "n_comment": "comment"})
    r = _t(spark, sf_dir, "region")
    j = n.join(r, n.regionkey == r.r_regionkey)
    areaname = F.when(F.col("r_name") == "MIDDLE EAST",
                      F.concat("name", F.lit(", "), "r_name")).otherwise(area_name("name", "r_name"))
    j = j.select("areasymbol", areaname.alias("areaname"), F.col("r_name").alias("state"),
                 F.concat(F.lit("  "), F.lower("name"), F.lit(" ")).alias("padded"))
    return j.select("areasymbol", "areaname", "state",
                    clean.county_name("areaname").alias("county"),
                    norm_key("padded").alias("key"),
                    F.col("areaname").endswith(", AMERICA").alias("in_america"))


def q_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, day-of-year) back to a date, equal to the ship date."""
    li = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"),
        F.dayofyear("l_shipdate").alias("yday"), F.to_date("l_shipdate").alias("ship"))
    d = day_of_year_date("year", "yday")
    return li.select("l_orderkey", "l_linenumber", "year", "yday", d.alias("date"),
                     F.month(d).alias("month"), (d == F.col("ship")).alias("same"))


def catalog_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey catalog from suppliers: two areas per nation (by balance sign),
    boxes from balance and supplier key ranges."""
    s = _t(spark, sf_dir, "supplier")
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    sym = F.concat(F.col("n_nationkey").cast("string"),
                   F.when(F.col("s_acctbal") >= 0, F.lit("-P")).otherwise(F.lit("-N")))
    return j.groupBy(area_name("n_name", "r_name").alias("areaname"), sym.alias("areasymbol")).agg(
        F.min("s_acctbal").alias("mbrminx"), F.max("s_acctbal").alias("mbrmaxx"),
        F.min("s_suppkey").cast("double").alias("mbrminy"),
        F.max("s_suppkey").cast("double").alias("mbrmaxy"))


def q_box_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(clean.box_center(catalog_stand_in(spark, sf_dir)), DIGITS)


def yield_csv_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the landed yield CSV: text columns, mixed case and blanks,
    YIELD and non-YIELD items, values with and without thousands separators."""
    o = _t(spark, sf_dir, "orders")
    c = _t(spark, sf_dir, "customer")
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
          .join(r, n.n_regionkey == r.r_regionkey))
    st = F.col("o_orderstatus")
    item = (F.when(st == "F", F.concat("o_orderpriority", F.lit(" - YIELD, MEASURED IN BU / ACRE")))
             .when(st == "O", F.concat("o_orderpriority", F.lit(" - PRODUCTION")))
             .otherwise(F.concat(F.lower("o_orderpriority"), F.lit(" - yield"))))
    value = F.when(st == "P", F.format_number("o_totalprice", 2)).otherwise(
        F.col("o_totalprice").cast("string"))
    return j.select(F.concat(F.lit(" "), F.lower("r_name"), F.lit(" ")).alias("State"),
                    F.col("n_name").alias("County"),
                    F.year("o_orderdate").cast("string").alias("Year"),
                    F.col("o_orderpriority").alias("Commodity"), item.alias("Data Item"),
                    value.alias("Value"), F.col("c_mktsegment").alias("Ag District"),
                    F.col("c_nationkey").cast("double").cast("string").alias("County ANSI"))


def q_yield_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F6, C4, C12 for the AMERICA counties, 1996-2000."""
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region").filter(F.col("r_name") == "AMERICA")
    requests = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("county"), F.lower("r_name").alias("state"))
    out = clean.clean_yield_csv(yield_csv_stand_in(spark, sf_dir), 1996, 2000, requests)
    return round_doubles(out, DIGITS)


def q_catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + J8: EUROPE's catalog rows attached to orders by composed area name."""
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    catalog = read_catalog(nr.select(F.col("n_nationkey").alias("areasymbol"),
                                     area_name("n_name", "r_name").alias("areaname")),
                           state="EUROPE")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    keyed = (o.join(c, o.o_custkey == c.c_custkey).join(nr, c.c_nationkey == nr.n_nationkey)
              .select("o_orderkey", F.lower("n_name").alias("county"), F.col("r_name").alias("state")))
    return clean.catalog_join(keyed, catalog).select("o_orderkey", "areasymbol",
                                                     F.col("county").alias("order_county"),
                                                     F.col("areaname"))


# --------------------------------------------------------------------------- gaps
def orders_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))


def q_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch ranges of missing years 1995-2001 per customer."""
    return gaps.fetch_plan(orders_years(spark, sf_dir), ["o_custkey"], 1995, 2001)


def q_keep_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the years in which their customer had nothing shipped."""
    o = orders_years(spark, sf_dir)
    shipped = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"))
    target = shipped.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ranges = gaps.fetch_plan(target, ["o_custkey"], 1992, 2001)
    kept = gaps.keep_missing(o, ranges, ["o_custkey"], crop="1-URGENT", crop_col="o_orderpriority")
    return round_doubles(kept.select("o_orderkey", "o_custkey", "year", "o_orderpriority",
                                     "o_totalprice"), DIGITS)


# --------------------------------------------------------------------------- upsert
LI_KEY = ["l_orderkey", "l_linenumber"]
LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]
SPLIT_DATE = "1998-01-01"


def lineitem_batches(spark: SparkSession, sf_dir: str):
    li = _t(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
    return (li.filter(F.col("l_shipdate") < F.lit(SPLIT_DATE)),
            li.filter(F.col("l_shipdate") >= F.lit(SPLIT_DATE)))


def q_upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 + K2: later lineitem rows replace earlier ones key by key."""
    before, after = lineitem_batches(spark, sf_dir)
    target = upsert.last_per_key(before, LI_KEY, LI_ORDER, keep_order=True)
    return round_doubles(upsert.replace(target, after, LI_KEY, LI_ORDER), DIGITS)


def q_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures overwritten, nullable codes kept when the batch has NULL."""
    before, after = lineitem_batches(spark, sf_dir)
    target = upsert.last_per_key(
        before.select(*LI_KEY, *LI_ORDER, "l_quantity", "l_extendedprice",
                      F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")),
        LI_KEY, LI_ORDER)
    batch = after.select(*LI_KEY, *LI_ORDER, "l_quantity", "l_extendedprice",
                         F.nullif("l_returnflag", F.lit("N")).alias("flag"),
                         F.nullif("l_linestatus", F.lit("O")).alias("status"))
    out = upsert.merge(target, batch, LI_KEY, LI_ORDER, overwrite=["l_quantity", "l_extendedprice"],
                       keep_if_null=["flag", "status"])
    return round_doubles(out, DIGITS)


def q_upsert_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K3 on a bucketed stored table: the same merge, with the batch's shuffle only."""
    before, after = lineitem_batches(spark, sf_dir)
    table = f"bucketed_{uuid.uuid4().hex}"
    flag = lambda df: df.select(*LI_KEY, *LI_ORDER, "l_quantity", "l_extendedprice",
                                F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    args = (LI_KEY, LI_ORDER, ["l_quantity", "l_extendedprice"], ["flag", "status"])
    place = {"buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "location": scratch_path(spark, "bucketed")}
    bucketed.upsert_bucketed(flag(before), table, *args, **place)
    batch = flag(after).withColumns({"flag": F.nullif("flag", F.lit("N")), "status": F.nullif("status", F.lit("O"))})
    return round_doubles(spark.table(bucketed.upsert_bucketed(batch, table, *args, **place)), DIGITS)


def q_upsert_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 sink: a batch without two measures nulls them for its own keys only."""
    before, after = lineitem_batches(spark, sf_dir)
    path = scratch_path(spark, "narrow")
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    upsert.upsert_table(spark, path, before, LI_KEY, LI_ORDER, measures,
                        partition_by=["l_linenumber"], mode="replace")
    upsert.upsert_table(spark, path, after.drop("l_discount", "l_tax"), LI_KEY, LI_ORDER, measures,
                        partition_by=["l_linenumber"], mode="replace")
    out = spark.read.schema(before.select(*LI_KEY, *measures).schema).parquet(path)
    return round_doubles(out, DIGITS)


def q_records_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two service records per order; other statistics and units go, columns are judged per file."""
    o = _t(spark, sf_dir, "orders")
    odd = F.col("o_orderkey") % 2 == 1

    def record(unit: str, district):
        return F.struct(
            F.year("o_orderdate").cast("string").alias("year"), F.format_number("o_totalprice", 2).alias("Value"),
            F.col("o_orderpriority").alias("commodity_desc"), district.alias("asd_desc"),
            (F.col("o_custkey") % 100).cast("string").alias("county_ansi"), F.lit(unit).alias("unit_desc"),
            F.concat(F.lit("C"), F.col("o_custkey") % 10).alias("county_name"), F.lit("S").alias("state_name"),
            F.lit("SURVEY").alias("source_desc"), F.lit("CROPS").alias("sector_desc"),
            F.lit("FIELD CROPS").alias("group_desc"),
            F.when(F.col("o_orderkey") % 3 == 0, "PRODUCTION").otherwise("YIELD").alias("statisticcat_desc"),
            F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise("COUNTY").alias("agg_level_desc"))

    raw = o.select(F.col("o_orderkey").cast("string").alias("src_file"), F.array(
        record("BU / ACRE", F.when(F.col("o_orderstatus") != "P", "AD")),
        record("BU", F.when(odd, "AD"))).alias("data"))
    return round_doubles(clean.clean_yield_json(explode_records(raw, ["src_file"])), DIGITS)


def q_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-2, Q2: a state with half its years stored, and one with nothing stored, filled from the landed rows."""
    landed = model.materialize(yields_stand_in(spark, sf_dir))
    store = scratch_path(spark, "backfill")
    half = (F.col("year") + F.length("county")) % 2 == 0
    upsert.publish(spark, landed.filter(half & (F.col("state") != "EUROPE")), f"{store}/yields", ["state"], stage=False)
    rows = landed.withColumns({"src_file": F.lit("f"), "src_block": F.lit(0).cast("long"), "src_row": F.lit(0).cast("long")})
    catalog = catalog_stand_in(spark, sf_dir)
    a = ingest.backfill(spark, store, rows, "america", "1-urgent", 1992, 1998, catalog)
    a = model.materialize(a)
    b = ingest.backfill(spark, store, rows, "europe", "1-urgent", 1992, 1998, catalog)
    return round_doubles(a.unionByName(b), DIGITS)


# --------------------------------------------------------------------------- profile
NUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RANK_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
CAT_COLS = ["p_name", "p_brand", "p_type"]


def _li(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem")


def q_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(profile.overview(_li(spark, sf_dir)), DIGITS)


def q_profile_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _li(spark, sf_dir)
    vc = profile.value_counts(li, NUM_COLS)
    out = profile.numeric_profile(li, NUM_COLS, vc).join(profile.quantiles(li, NUM_COLS, vc=vc), "feature")
    return round_doubles(out, DIGITS)


def q_sketch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P3 from merged sketches of stored partitions; what is estimated is held against the exact profile."""
    li = _li(spark, sf_dir)
    path = sketch.write_sketches(sketch.column_sketches(li, ["l_returnflag"], NUM_COLS), scratch_path(spark, "sketches"),
                                 ["l_returnflag"])
    m = sketch.merged_profile(spark.read.parquet(path))
    vc = profile.value_counts(li, NUM_COLS)
    exact = profile.numeric_profile(li, NUM_COLS, vc).select("feature", F.col("distinct").alias("values"))
    ranks = vc.join(F.broadcast(m.select("feature", "p50", "p95", "count")), "feature").groupBy("feature").agg(*[
        (F.abs(F.sum(F.when(F.col("value") <= F.col(p), F.col("c")).otherwise(0)) / F.max("count") - q) <= tie + 0.02).alias(p + "_near")
        for p, q, tie in (("p50", 0.5, 0.1), ("p95", 0.95, 0.1))])
    out = m.join(exact, "feature").join(ranks, "feature").select(
        "feature", "count", "missing", "min", "max", "mean",
        (F.abs(F.col("distinct") - F.col("values")) <= 0.06 * F.col("values")).alias("distinct_near"), "p50_near", "p95_near")
    return round_doubles(out, DIGITS)


def q_profile_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary, _ = profile.category_profile(_t(spark, sf_dir, "part"), CAT_COLS)
    return round_doubles(summary, DIGITS)


def q_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, top = profile.category_profile(_t(spark, sf_dir, "part"), CAT_COLS)
    return top


def q_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(profile.histogram(_li(spark, sf_dir), NUM_COLS), DIGITS)


def nullable_lineitem(spark, sf_dir):
    return _li(spark, sf_dir).select(
        "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"))


def q_nullity(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_col, _ = profile.nullity(nullable_lineitem(spark, sf_dir))
    return round_doubles(per_col, DIGITS)


def q_nullity_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pairs = profile.nullity(nullable_lineitem(spark, sf_dir))
    return round_doubles(pairs, DIGITS)


def q_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(profile.pearson(_li(spark, sf_dir), NUM_COLS), DIGITS)


def q_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(profile.spearman(_li(spark, sf_dir), RANK_COLS), DIGITS)


def q_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _li(spark, sf_dir).select(
        "l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("discount_pct"))
    return round_doubles(profile.kendall_pair(li, "l_linenumber", "discount_pct"), DIGITS)


def _size_class(li: DataFrame) -> DataFrame:
    return li.withColumn("size_class", F.when(F.col("l_quantity") > 25, "big").otherwise("small"))


def q_cramers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _size_class(_li(spark, sf_dir))
    return round_doubles(profile.chi_square_pairs(li, [("l_returnflag", "l_linestatus"), ("l_linestatus", "size_class")]),
                         DIGITS)


def q_phik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phi_k of two-valued columns, where the normal's correlation has a closed form."""
    li = _size_class(_li(spark, sf_dir)).withColumns({
        "late": F.year("l_shipdate") >= 1996, "dear": F.col("l_extendedprice") > 30000})
    return round_doubles(phik.phik_matrix(li, [], ["l_linestatus", "size_class", "late", "dear"]), DIGITS)


def ranks_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _li(spark, sf_dir).select(
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.02)).alias("l_tax"))


def q_spearman_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 where each pair has complete rows of its own."""
    return round_doubles(profile.spearman(ranks_with_nulls(spark, sf_dir)), DIGITS)


def q_profile_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, P7, P11 with NaN in two columns: NaN is missing in all of them."""
    d = ranks_with_nulls(spark, sf_dir).select(
        *[F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in ("l_quantity", "l_discount")], "l_extendedprice")
    per_col, pairs = profile.nullity(d)
    found = [profile.pearson(d).select(F.lit("pearson").alias("kind"), "x", "y", F.col("r").alias("value")),
             profile.spearman(d).select(F.lit("spearman").alias("kind"), "x", "y", F.col("r").alias("value")),
             pairs.select(F.lit("missing").alias("kind"), "x", "y", F.col("r").alias("value")),
             per_col.select(F.lit("missing").alias("kind"), F.col("feature").alias("x"), F.col("feature").alias("y"),
                            F.col("missing").cast("double").alias("value"))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return round_doubles(out, DIGITS)


def q_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _li(spark, sf_dir)
    out = profile.auto_matrix(li, ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"])
    return round_doubles(out, DIGITS)


def q_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _li(spark, sf_dir).select(*NUM_COLS, "l_linenumber",
                                   F.nullif("l_tax", F.lit(0.0)).alias("tax_or_null"))
    return round_doubles(profile.alerts(li), DIGITS)


# --------------------------------------------------------------------------- select / model / explain
FRAME_KEY = ["state", "county", "year", "crop"]
FRAME_FEATURES = ["avg_temp", "precipitation", "vp", "srad", "gdd", "ph", "organic_matter",
                  "sand_pct", "clay_pct"]
SHAP_FEATURES = ["avg_temp", "precipitation", "gdd", "ph"]


def round_fixed(df: DataFrame, digits: int) -> DataFrame:
    """Fixed-decimal comparison rounding for per-row model outputs."""
    return df.select(*[
        (F.round(F.col(f.name) * F.lit(float(NUDGE)), digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def round_sig(df: DataFrame, cols: list[str], sig: int = 6) -> DataFrame:
    """Significant-digit comparison rounding for small per-row statistics."""
    return df.select(*[
        F.format_string(f"%.{sig - 1}e", F.col(c) * F.lit(float(NUDGE))).cast("double").alias(c)
        if c in cols else F.col(c) for c in df.columns])


def q_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _li(spark, sf_dir).select("l_orderkey", "l_linenumber",
                                   F.nullif("l_discount", F.lit(0.0)).alias("discount"))
    return round_doubles(select.impute_mean(li, ["discount"]), DIGITS)


MI_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def q_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.mutual_information(_li(spark, sf_dir), MI_FEATURES, "l_extendedprice")
    return round_doubles(out, DIGITS)


KNN_FEATURES = ["orders", "dearest", "c_acctbal"]


def q_mi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 by nearest neighbours: what a customer's numbers say about the sum of the orders."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("dearest"),
        F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return round_doubles(knn_mi.knn_mutual_information(d, KNN_FEATURES, "spent"), DIGITS)


def q_mrmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(select.mrmr(_li(spark, sf_dir), MI_FEATURES, "l_extendedprice"), DIGITS)


def lineitem_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax",
                                   "l_extendedprice")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    return (li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
              .join(r, n.n_regionkey == r.r_regionkey)
              .select("l_orderkey", "l_linenumber", F.col("r_name").alias("region"),
                      "l_quantity", "l_discount", "l_tax", "l_extendedprice"))


def q_ols_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 + M5: price on quantity, one least-squares line per region."""
    d = lineitem_regions(spark, sf_dir)
    return round_doubles(model.grouped_ols(d, ["region"], ["l_quantity"], "l_extendedprice"),
                         DIGITS)


def q_regional_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 with trees: price on three features, a tree of depth 2 per region, all grown together."""
    d = lineitem_regions(spark, sf_dir)
    return round_doubles(regional.grouped_trees(d, ["region"], MI_FEATURES, "l_extendedprice", max_depth=2, bins=8), DIGITS)


def _region_predictions(spark, sf_dir):
    d = lineitem_regions(spark, sf_dir)
    coefs = model.grouped_ols(d, ["region"], ["l_quantity"], "l_extendedprice")
    return model.predict_grouped(d, coefs, ["region"], ["l_quantity"]).withColumnRenamed(
        "l_extendedprice", "label")


def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: regression metrics of the per-region fits."""
    return round_doubles(model.metrics(_region_predictions(spark, sf_dir), ["region"]), DIGITS)


def q_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual table of the per-region fits."""
    res = model.residuals(_region_predictions(spark, sf_dir), ["l_orderkey", "l_linenumber",
                                                               "region"])
    return round_fixed(res, 2)


def q_error_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction-error line (prediction on label) of the per-region fits."""
    return round_doubles(model.prediction_error_line(_region_predictions(spark, sf_dir),
                                                     ["region"]), DIGITS)


def q_linear_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form SHAP of one global least-squares line (background = all rows)."""
    li = _li(spark, sf_dir)
    c = model.grouped_ols(li.withColumn("_all", F.lit(1)), ["_all"], ["l_quantity"],
                          "l_extendedprice").first()       # p + 1 numbers
    mean = li.agg(F.avg("l_quantity")).first()[0]
    out = explain.linear_shap(li, ["l_orderkey", "l_linenumber"], {"l_quantity": c["l_quantity"]},
                              c["intercept"], {"l_quantity": mean})
    return round_fixed(out, 2)


def q_cooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model.cooks_distance(_li(spark, sf_dir), ["l_orderkey", "l_linenumber"],
                               ["l_quantity"], "l_extendedprice")
    out = round_sig(out, ["leverage", "cooks"], 6)
    return out.select("l_orderkey", "l_linenumber", "leverage",
                      (F.round(F.col("residual") * F.lit(float(NUDGE)), 2) + F.lit(0.0))
                      .alias("residual"), "cooks")


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training frame, checkpointed once: fits and explanations rescan it."""
    y, w, s = stand_in_tables(spark, sf_dir)
    return model.materialize(frame.build_frame(y, w, s))


def q_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4, M5-M8: 3-fold comparison leaderboard on the training frame."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    models = {"lr": LinearRegression(labelCol="label", solver="normal"),
              "rf": RandomForestRegressor(labelCol="label", seed=model.SEED, numTrees=20),
              "gbr": GBTRegressor(labelCol="label", seed=model.SEED, maxIter=10),
              "ada": model.AdaBoostRegressor(labelCol="label", n_estimators=5),
              "et": model.ExtraTreesRegressor(labelCol="label", n_estimators=3, max_depth=8)}
    board, _ = model.compare_models(frame_table(spark, sf_dir), FRAME_KEY, FRAME_FEATURES,
                                    "yield", models=models, folds=3)
    return board


def q_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14 + M16 + K7 path: fit a forest, report importances."""
    from pyspark.ml.regression import RandomForestRegressor
    m = model.fit(frame_table(spark, sf_dir), FRAME_KEY, FRAME_FEATURES, "yield",
                  RandomForestRegressor(labelCol="label", seed=model.SEED, numTrees=20))
    return model.importance(m, FRAME_FEATURES)


def q_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.learning_curve(frame_table(spark, sf_dir), FRAME_KEY, FRAME_FEATURES, "yield")


def q_vc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.regression import DecisionTreeRegressor
    return model.validation_curve(frame_table(spark, sf_dir), FRAME_KEY, FRAME_FEATURES, "yield",
                                  DecisionTreeRegressor(labelCol="label", seed=model.SEED),
                                  "maxDepth", [2, 4, 6])


def q_learning_gdd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 on one feature: a least-squares line per share of the training split."""
    return round_doubles(model.learning_curve(frame_table(spark, sf_dir), FRAME_KEY, ["gdd"], "yield"), DIGITS)


def q_vc_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 on one feature: the penalty of a ridge line over a grid."""
    from pyspark.ml.regression import LinearRegression
    out = model.validation_curve(frame_table(spark, sf_dir), FRAME_KEY, ["gdd"], "yield",
                                 LinearRegression(labelCol="label", solver="normal"), "regParam",
                                 [0.0, 1000.0, 10000.0, 100000.0])
    return round_doubles(out, DIGITS)


def q_ada(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: AdaBoost.R2 fit and in-sample metrics."""
    f = frame_table(spark, sf_dir)
    m = model.fit(f, FRAME_KEY, FRAME_FEATURES, "yield",
                  model.AdaBoostRegressor(labelCol="label", n_estimators=8))
    pred = m.transform(f.withColumn("label", F.col("yield")))
    return model.metrics(pred, [])


def q_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of a full forest for every frame row and feature, and global importance."""
    f = frame_table(spark, sf_dir)
    m = model.fit(f, FRAME_KEY, FRAME_FEATURES, "yield", model.estimators()["rf"])
    return explain.global_importance(explain.shap_values(m, f, FRAME_KEY, FRAME_FEATURES, engine="tree"))


def q_shap_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, the general engine on a model that is not linear: quantity times discount of every order."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer
    d = _li(spark, sf_dir).groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"), F.count(F.lit(1)).alias("lines"))
    background = d.groupBy("lines").agg(F.round(F.avg("quantity"), 1).alias("quantity"),
                                        F.round(F.avg("discount"), 3).alias("discount"))     # a row per line count
    m = PipelineModel([SQLTransformer(statement="SELECT *, quantity * discount AS prediction FROM __THIS__")])
    out = explain.shap_values(m, d, ["l_orderkey"], ["quantity", "discount"], background=background, engine="coalition")
    return round_fixed(out, 6)


def q_shap_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 machinery checked in closed form: Shapley values of a one-feature
    least-squares model with the whole frame as background equal
    slope * (x - mean) and their base equals the mean label."""
    from pyspark.ml.regression import LinearRegression
    f = frame_table(spark, sf_dir)
    m = model.fit(f, FRAME_KEY, ["gdd"], "yield", LinearRegression(labelCol="label",
                                                                 solver="normal"))
    sv = explain.shap_values(m, f, FRAME_KEY, ["gdd"], background=f.select("gdd"))
    return round_fixed(sv.select(*FRAME_KEY, "feature", "shap", "base"), 2)


def q_lime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIME explanation of the drill-down row."""
    f = frame_table(spark, sf_dir)
    m = model.fit(f, FRAME_KEY, FRAME_FEATURES, "yield")
    row = query.pick_row(f, ["county", "year", "crop"], county="NATION_3", year=1997)
    return explain.lime(m, f, row, FRAME_KEY, FRAME_FEATURES)


# --------------------------------------------------------------------------- registry
QUERIES = {
    "q_season": q_season,
    "q_season_simple": q_season_simple,
    "q_cum_gdd": q_cum_gdd,
    "q_season_windows": q_season_windows,
    "q_weighted": q_weighted,
    "q_texture": q_texture,
    "q_frame": q_frame,
    "q_unmatched": q_unmatched,
    "q_unmatched_rows": q_unmatched_rows,
    "q_scope": q_scope,
    "q_pick": q_pick,
    "q_yield_query": q_yield_query,
    "q_weather_query": q_weather_query,
    "q_soil_query": q_soil_query,
    "q_crop_list": q_crop_list,
    "q_year_counts": q_year_counts,
    "q_span": q_span,
    "q_head_tail": q_head_tail,
    "q_clean_numeric": q_clean_numeric,
    "q_clean_names": q_clean_names,
    "q_dates": q_dates,
    "q_box_center": q_box_center,
    "q_yield_rows": q_yield_rows,
    "q_catalog_join": q_catalog_join,
    "q_gaps": q_gaps,
    "q_keep_missing": q_keep_missing,
    "q_upsert_batch": q_upsert_batch,
    "q_upsert_merge": q_upsert_merge,
    "q_upsert_bucketed": q_upsert_bucketed,
    "q_upsert_narrow": q_upsert_narrow,
    "q_records_filter": q_records_filter,
    "q_backfill": q_backfill,
    "q_overview": q_overview,
    "q_profile_num": q_profile_num,
    "q_sketch_profile": q_sketch_profile,
    "q_profile_cat": q_profile_cat,
    "q_top_values": q_top_values,
    "q_hist": q_hist,
    "q_nullity": q_nullity,
    "q_nullity_corr": q_nullity_corr,
    "q_pearson": q_pearson,
    "q_spearman": q_spearman,
    "q_spearman_null": q_spearman_null,
    "q_profile_nan": q_profile_nan,
    "q_kendall": q_kendall,
    "q_cramers": q_cramers,
    "q_phik": q_phik,
    "q_auto": q_auto,
    "q_alerts": q_alerts,
    "q_impute": q_impute,
    "q_mi": q_mi,
    "q_mi_knn": q_mi_knn,
    "q_mrmr": q_mrmr,
    "q_ols_group": q_ols_group,
    "q_regional_trees": q_regional_trees,
    "q_metrics": q_metrics,
    "q_residuals": q_residuals,
    "q_error_line": q_error_line,
    "q_linear_shap": q_linear_shap,
    "q_cooks": q_cooks,
    "q_compare": q_compare,
    "q_importance": q_importance,
    "q_learning": q_learning,
    "q_vc": q_vc,
    "q_learning_gdd": q_learning_gdd,
    "q_vc_ridge": q_vc_ridge,
    "q_ada": q_ada,
    "q_shap": q_shap,
    "q_shap_product": q_shap_product,
    "q_shap_linear": q_shap_linear,
    "q_lime": q_lime,
}

FLAGSHIP = q_frame
