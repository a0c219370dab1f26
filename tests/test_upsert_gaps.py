import os

from pyspark.sql import functions as F

from cropframe.operators import gaps, upsert
from cropframe.plans import ingest
from cropframe.sources import schemas
from cropframe.streaming.upsert_stream import stream_upsert
from helpers import rows, write_text
from test_sources import SOIL, YIELD_CSV

KEY = ["k"]


def test_year_ranges_docstring_example(spark):
    df = spark.createDataFrame([(1, y) for y in [1990, 1991, 1992, 2021, 2022]] + [(2, 2000)],
                               "k int, year int")
    got = rows(gaps.year_ranges(df, KEY), ["k", "range_start"])
    assert [(r["k"], r["range_start"], r["range_end"]) for r in got] == [
        (1, 1990, 1992), (1, 2021, 2022), (2, 2000, 2000)]
    assert gaps.year_ranges(df.limit(0), KEY).count() == 0


def test_missing_years_cover_exactly(spark):
    df = spark.createDataFrame([(1, 1995), (1, 1997), (1, 1997), (2, 1994), (3, 2001)],
                               "k int, year int")
    plan = gaps.fetch_plan(df, KEY, 1995, 2001)
    got = {(r["k"], y) for r in plan.collect()
           for y in range(r["range_start"], r["range_end"] + 1)}
    want = {(k, y) for k in (1, 2, 3) for y in range(1995, 2002)} - {(1, 1995), (1, 1997),
                                                                      (3, 2001)}
    assert got == want
    # ranges never touch: a gap of at least one year separates two ranges of a key
    per = {}
    for r in plan.collect():
        per.setdefault(r["k"], []).append((r["range_start"], r["range_end"]))
    for rs in per.values():
        rs.sort()
        assert all(b[0] > a[1] + 1 for a, b in zip(rs, rs[1:]))


def test_fallback_keys_when_state_empty(spark):
    stored = spark.createDataFrame([("A", "X", "CORN", 2000)],
                                   "county string, state string, crop string, year int")
    catalog = spark.createDataFrame([("C1",), ("C2",)], "county string")
    plan = ingest.backfill_plan(stored, "Y", None, 2000, 2001, catalog)
    got = sorted((r["county"], r["range_start"], r["range_end"]) for r in plan.collect())
    assert got == [("C1", 2000, 2001), ("C2", 2000, 2001)]


def test_keep_missing_semi_join(spark):
    landed = spark.createDataFrame([(1, 1995, "A"), (1, 1996, "B"), (2, 1995, "A")],
                                   "k int, year int, crop string")
    ranges = spark.createDataFrame([(1, 1995, 1995)], "k int, range_start int, range_end int")
    assert [tuple(r) for r in gaps.keep_missing(landed, ranges, KEY).collect()] == [(1, 1995, "A")]


def _batch(spark, data):
    return spark.createDataFrame(data, "k int, o int, v double, d string")


def test_merge_rules_and_idempotence(spark):
    target = spark.createDataFrame([(1, 1.0, "old"), (2, 2.0, "keep")], "k int, v double, d string")
    batch = _batch(spark, [(1, 1, 10.0, "new"), (1, 2, 11.0, None), (3, 1, None, None)])
    once = upsert.merge(target, batch, KEY, "o", ["v"], ["d"])
    got = {r["k"]: (r["v"], r["d"]) for r in once.collect()}
    # last row wins for v (even NULL), last non-NULL for d, untouched key kept
    assert got == {1: (11.0, "new"), 2: (2.0, "keep"), 3: (None, None)}
    twice = upsert.merge(once, batch, KEY, "o", ["v"], ["d"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_replace_nulls_absent_measures(spark):
    target = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 6.0)], "k int, a double, b double")
    batch = spark.createDataFrame([(1, 0, 9.0)], "k int, o int, a double")
    got = {r["k"]: (r["a"], r["b"]) for r in upsert.replace(target, batch, KEY, "o").collect()}
    assert got == {1: (9.0, None), 2: (2.0, 6.0)}


def test_upsert_table_partition_overwrite(spark, tmp):
    path = os.path.join(tmp, "t")
    b1 = spark.createDataFrame([(1, "A", 0, 1.0, None), (2, "B", 0, 2.0, "x")],
                               "k int, state string, o int, v double, d string")
    upsert.upsert_table(spark, path, b1, ["k", "state"], "o", ["v"], ["d"], partition_by=["state"])
    b2 = spark.createDataFrame([(1, "A", 1, 5.0, "y")], "k int, state string, o int, v double, d string")
    upsert.upsert_table(spark, path, b2, ["k", "state"], "o", ["v"], ["d"], partition_by=["state"])
    upsert.upsert_table(spark, path, b2, ["k", "state"], "o", ["v"], ["d"], partition_by=["state"])
    got = sorted((r["k"], r["state"], r["v"], r["d"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, "A", 5.0, "y"), (2, "B", 2.0, "x")]


def _land(tmp):
    write_text(os.path.join(tmp, "landing", "y1.csv"), YIELD_CSV)
    for name, text in SOIL.items():
        write_text(os.path.join(tmp, "soil", name, "t.csv"), text)


def test_bulk_ingest_end_to_end(spark, tmp):
    _land(tmp)
    days = [("Wake", "NORTH CAROLINA", 1990, 150, 30.0, 20.0, 2.0, 1.0, 1.0),
            ("WAKE", "North Carolina", 1990, 150, 30.0, 20.0, 2.0, 1.0, 1.0)]
    spark.createDataFrame(days, schemas.DAILY_GRID).write.parquet(os.path.join(tmp, "grid"))
    store = os.path.join(tmp, "store")
    plan = ingest.bulk_ingest(spark, os.path.join(tmp, "landing"), os.path.join(tmp, "grid"),
                              os.path.join(tmp, "soil"), store, dry_run=True)["plan"]
    assert plan.count() == 4  # raw (County, State) groups: case differs, NULL county dropped
    ingest.bulk_ingest(spark, os.path.join(tmp, "landing"), os.path.join(tmp, "grid"),
                       os.path.join(tmp, "soil"), store)
    y = spark.read.parquet(os.path.join(store, "yields"))
    assert y.count() == 3
    w = spark.read.parquet(os.path.join(store, "weather"))
    assert w.filter(F.col("county") == "Wake").first()["gdd"] == 15.0


def test_stream_upsert_available_now(spark, tmp):
    _land(tmp)
    store = os.path.join(tmp, "store")
    q = stream_upsert(spark, os.path.join(tmp, "landing"), store,
                      checkpoint=os.path.join(tmp, "ckpt"))
    q.awaitTermination(120)
    first = sorted(map(tuple, spark.read.parquet(os.path.join(store, "yields")).select(
        "county", "year", "value").collect()))
    assert len(first) == 3
    # a second run with no new files changes nothing
    q = stream_upsert(spark, os.path.join(tmp, "landing"), store,
                      checkpoint=os.path.join(tmp, "ckpt"))
    q.awaitTermination(120)
    again = sorted(map(tuple, spark.read.parquet(os.path.join(store, "yields")).select(
        "county", "year", "value").collect()))
    assert again == first
    # a new file lands: only its rows are merged (one update, one insert)
    write_text(os.path.join(tmp, "landing", "y2.csv"),
               "State,County,Year,Commodity,Data Item,Value,Ag District,County ANSI\n"
               "NORTH CAROLINA,Wake,1990,CORN,CORN - YIELD,99,,\n"
               "NORTH CAROLINA,Wake,1995,CORN,CORN - YIELD,7,,\n")
    q = stream_upsert(spark, os.path.join(tmp, "landing"), store,
                      checkpoint=os.path.join(tmp, "ckpt"))
    q.awaitTermination(120)
    third = {(r["county"], r["year"]): (r["value"], r["district"]) for r in
             spark.read.parquet(os.path.join(store, "yields")).collect()}
    assert len(third) == 4
    assert third[("Wake", 1990)] == (99.0, "CENTRAL")   # value replaced, district kept
    assert third[("Wake", 1995)] == (7.0, None)


def test_stream_upsert_json_records(spark, tmp):
    import json
    rec = {"year": "2020", "Value": "1,234", "commodity_desc": "CORN", "asd_desc": "CENTRAL",
           "county_ansi": "37", "unit_desc": "BU / ACRE", "county_name": "WAKE",
           "state_name": "NORTH CAROLINA"}
    write_text(os.path.join(tmp, "landing_j", "a.json"), json.dumps({"data": [rec]}))
    store = os.path.join(tmp, "store_j")
    q = stream_upsert(spark, os.path.join(tmp, "landing_j"), store,
                      checkpoint=os.path.join(tmp, "ckpt_j"), kind="json")
    q.awaitTermination(120)
    got = [(r["county"], r["year"], r["value"]) for r in
           spark.read.parquet(os.path.join(store, "yields")).collect()]
    assert got == [("WAKE", 2020, 1234.0)]


def test_backfill_end_to_end(spark, tmp):
    store = os.path.join(tmp, "store")
    cols = ("year int, state string, district string, county string, county_ansi string, "
            "crop string, value double, unit string")
    stored = spark.createDataFrame([(2000, "NC", "C", "Wake", "37", "CORN", 1.0, "u"),
                                    (2002, "NC", "C", "Wake", "37", "CORN", 3.0, "u")], cols)
    stored.write.partitionBy("state").parquet(os.path.join(store, "yields"))
    landed = spark.createDataFrame(
        [(2000, "NC", None, "Wake", None, "CORN", 9.0, "u", "f", 0, 1),   # year present: ignored
         (2001, "NC", None, "Wake", None, "CORN", 2.0, "u", "f", 0, 2),   # missing year: filled
         (2001, "NC", None, "Wake", None, "SOY", 7.0, "u", "f", 0, 3)],   # other crop: ignored
        cols + ", src_file string, src_block long, src_row long")
    out = ingest.backfill(spark, store, landed, state="NC", crop="CORN", start_year=2000,
                          end_year=2002)
    got = sorted((r["year"], r["value"], r["district"]) for r in out.collect())
    assert got == [(2000, 1.0, "C"), (2001, 2.0, None), (2002, 3.0, "C")]


def test_bulk_ingest_from_records(spark, tmp):
    import json
    _land(tmp)
    rec = {"year": "1990", "Value": "1,234", "commodity_desc": "CORN", "asd_desc": "CENTRAL",
           "county_ansi": "37", "unit_desc": "BU / ACRE", "county_name": "WAKE",
           "state_name": "NORTH CAROLINA"}
    write_text(os.path.join(tmp, "recs", "a.json"), json.dumps({"data": [rec]}))
    spark.createDataFrame([("Wake", "NORTH CAROLINA", 1990, 150, 30.0, 20.0, 2.0, 1.0, 1.0)],
                          schemas.DAILY_GRID).write.parquet(os.path.join(tmp, "grid"))
    store = os.path.join(tmp, "store")
    ingest.bulk_ingest(spark, os.path.join(tmp, "landing"), os.path.join(tmp, "grid"),
                       os.path.join(tmp, "soil"), store,
                       yield_json_path=os.path.join(tmp, "recs"))
    got = sorted((r["county"], r["state"], r["value"])
                 for r in spark.read.parquet(os.path.join(store, "yields")).collect())
    # one record, stored under each raw (county, state) spelling whose year span holds its year
    assert got == [("WAKE", "North Carolina", 1234.0), ("Wake", "NORTH CAROLINA", 1234.0)]


def test_replace_with_a_narrow_batch_keeps_other_keys(spark, tmp):
    path = os.path.join(tmp, "weather")
    cols = schemas.WEATHER
    spark.createDataFrame([("A", "NC", 2000, 1.0, 2.0, 3.0, 4.0, 5.0), ("B", "NC", 2000, 1.5, 2.5, 3.5, 4.5, 5.5),
                           ("C", "SC", 2000, 9.0, 9.0, 9.0, 9.0, 9.0)], cols).write.partitionBy("state").parquet(path)
    batch = spark.createDataFrame([("A", "NC", 2000, 7.0, 8.0, 6.0, 0)],
                                  "county string, state string, year int, avg_temp double, precipitation double, "
                                  "gdd double, _o int")
    upsert.upsert_table(spark, path, batch, schemas.WEATHER_KEY, "_o", ingest.WEATHER_MEASURES,
                        partition_by=["state"], mode="replace", schema=schemas.WEATHER)
    got = sorted((r["county"], r["avg_temp"], r["vp"], r["srad"], r["gdd"])
                 for r in spark.read.schema(cols).parquet(path).collect())
    assert got == [("A", 7.0, None, None, 6.0), ("B", 1.5, 3.5, 4.5, 5.5), ("C", 9.0, 9.0, 9.0, 9.0)]


def test_merge_keeps_columns_it_does_not_know(spark, tmp):
    path = os.path.join(tmp, "t")
    spark.createDataFrame([("k1", 1, "x"), ("k2", 2, "y")], "k string, v int, extra string").write.parquet(path)
    batch = spark.createDataFrame([("k1", 5, 0), ("k3", 6, 0)], "k string, v int, o int")
    upsert.upsert_table(spark, path, batch, ["k"], "o", ["v"])
    got = sorted((r["k"], r["v"], r["extra"]) for r in spark.read.parquet(path).collect())
    assert got == [("k1", 5, "x"), ("k2", 2, "y"), ("k3", 6, None)]


def test_records_are_filtered_and_judged_by_the_columns_their_file_has(spark, tmp):
    import json
    from cropframe.operators import clean
    from cropframe.sources import read_yield_json
    base = {"year": "2000", "Value": "10", "commodity_desc": "CORN", "county_ansi": "37", "unit_desc": "BU / ACRE",
            "county_name": "WAKE", "state_name": "NC"}
    write_text(os.path.join(tmp, "r", "a.json"), json.dumps({"data": [
        base, base | {"unit_desc": "BU", "Value": "11"}, base | {"statisticcat_desc": "PRODUCTION", "Value": "12"},
        base | {"agg_level_desc": "STATE", "Value": "13"}, base | {"county_ansi": None, "Value": "14"},
        base | {"source_desc": "SURVEY", "Value": "15"}]}))
    got = clean.clean_yield_json(read_yield_json(spark, os.path.join(tmp, "r"))).collect()
    # no record of the file has a district, so none is dropped for lacking it
    assert sorted(r["value"] for r in got) == [10.0, 15.0]
    assert {r["district"] for r in got} == {None}


def test_backfill_normalises_and_falls_back_to_the_catalog(spark, tmp):
    cols = "year int, state string, district string, county string, county_ansi string, crop string, value double, unit string"
    store = os.path.join(tmp, "store")
    spark.createDataFrame([(2000, "SC", "C", "Lee", "1", "CORN", 1.0, "u")], cols).write.partitionBy("state").parquet(
        os.path.join(store, "yields"))
    landed = spark.createDataFrame([(y, "NC", None, c, None, "CORN", float(y), "u", "f", 0, y)
                                    for y in (2000, 2001) for c in ("WAKE", "LEE")],
                                   cols + ", src_file string, src_block long, src_row long")
    catalog = spark.createDataFrame([("Wake County, NC",), ("Durham County, NC",), ("Lee County, SC",)], "areaname string")
    out = ingest.backfill(spark, store, landed, "nc", "corn", 2000, 2002, catalog)
    assert sorted((r["county"], r["year"]) for r in out.collect()) == [("WAKE", 2000), ("WAKE", 2001)]


def test_bucketed_merge_shuffles_the_batch_only(spark, tmp):
    import uuid

    from cropframe.operators import bucketed, upsert
    table, key = f"stored_{uuid.uuid4().hex[:8]}", ["a", "b"]
    first = spark.range(400).selectExpr("id % 100 a", "id % 7 b", "id o", "id * 2 v", "if(id % 3 = 0, null, 'f') f")
    batch = spark.range(350, 600).selectExpr("id % 120 a", "id % 7 b", "id o", "id * 5 v", "if(id % 2 = 0, null, 'g') f")
    bucketed.upsert_bucketed(first, table, key, "o", ["v"], ["f"], buckets=5, location=tmp)
    stored = spark.table(bucketed.latest(spark, table))
    before = {tuple(r) for r in stored.collect()}
    merged = bucketed.merged(spark, table, batch, key, "o", ["v"], ["f"], buckets=5)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and plan.count("SelectedBucketsCount") == 1
    want = upsert.merge(spark.createDataFrame(list(before), stored.schema), batch, key, "o", ["v"], ["f"])
    name = bucketed.upsert_bucketed(batch, table, key, "o", ["v"], ["f"], buckets=5, location=tmp)
    assert name == f"{table}_v2" and {tuple(r) for r in spark.table(name).collect()} == {tuple(r) for r in want.collect()}
    bucketed.upsert_bucketed(batch, table, key, "o", ["v"], ["f"], buckets=5, location=tmp)      # twice = once
    assert bucketed._versions(spark, table) == [2, 3]
    assert {tuple(r) for r in spark.table(f"{table}_v3").collect()} == {tuple(r) for r in want.collect()}
    for v in (2, 3):
        spark.sql(f"DROP TABLE {table}_v{v}")
