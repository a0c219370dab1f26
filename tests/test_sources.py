import json
import os

from pyspark.sql import functions as F

from cropframe.operators import clean, season, soil
from cropframe.sources import (decode_response_table, read_daily_csv, read_daily_grid,
                               read_soil_tables, read_yield_csv, read_yield_json)
from helpers import rows, write_text

YIELD_CSV = """State,County,Year,Commodity,Data Item,Value,Ag District,County ANSI
NORTH CAROLINA , Wake ,1990,CORN,"CORN, GRAIN - YIELD, MEASURED IN BU / ACRE",45.2,CENTRAL,37
North Carolina,WAKE,1990,CORN,"CORN, SILAGE - YIELD, MEASURED IN TONS / ACRE", 50.0 ,,
NORTH CAROLINA,WAKE,1991,CORN,"CORN, GRAIN - PRODUCTION, MEASURED IN BU",999,CENTRAL,37
NORTH CAROLINA,WAKE,1992,SOYBEANS,"soybeans - yield, measured in bu / acre","1,234",CENTRAL,37
NORTH CAROLINA,WAKE,1993,SOYBEANS,,40,CENTRAL,37
NORTH CAROLINA,WAKE,1994,SOYBEANS,SOYBEANS - YIELD,(D),CENTRAL,37
NORTH CAROLINA,WAKE,2022,SOYBEANS,SOYBEANS - YIELD,45d,CENTRAL,
NORTH CAROLINA,OTHER COUNTIES,2022,SOYBEANS,SOYBEANS - YIELD,30,EAST,
NORTH CAROLINA,,,CORN,CORN - YIELD,31,EAST,
"""


def test_yield_csv_clean_rules(spark, tmp):
    p = write_text(os.path.join(tmp, "yield", "part1.csv"), YIELD_CSV)
    raw = read_yield_csv(spark, os.path.dirname(p))
    out = clean.clean_yield_csv(raw, 1980, 2024)
    got = rows(out.drop("src_file", "src_block", "src_row"), ["county", "year", "unit"])
    # non-YIELD item, NULL item, '1,234', '(D)', '45d' and NULL year are dropped
    assert [(r["county"], r["year"], r["value"]) for r in got] == [
        ("OTHER COUNTIES", 2022, 30.0), ("WAKE", 1990, 50.0), ("Wake", 1990, 45.2)]
    assert got[2]["county_ansi"] == "37" and got[1]["county_ansi"] is None


def test_yield_json_records(spark, tmp):
    rec = {"year": "2020", "Value": "1,234", "commodity_desc": "CORN", "asd_desc": "CENTRAL",
           "county_ansi": "37", "unit_desc": "BU / ACRE", "county_name": "WAKE",
           "state_name": "NORTH CAROLINA"}
    bad = dict(rec, county_ansi=None, year="2021")
    write_text(os.path.join(tmp, "j", "a.json"), json.dumps({"data": [rec, bad]}))
    write_text(os.path.join(tmp, "j", "b.json"), json.dumps(
        {"data": [{"year": "2019", "Value": "40", "county_name": "WAKE",
                   "state_name": "NORTH CAROLINA"}]}))
    write_text(os.path.join(tmp, "j", "c.json"), json.dumps({"data": []}))
    out = clean.clean_yield_json(read_yield_json(spark, os.path.join(tmp, "j")))
    got = rows(out, ["year"])
    assert [(r["year"], r["value"], r["crop"]) for r in got] == [(2019, 40.0, None),
                                                                 (2020, 1234.0, "CORN")]


def test_daily_grid_season_rules(spark, tmp):
    days = [  # county, state, year, yday, tmax, tmin, prcp, vp, srad
        ("Wake", "NC", 2021, 120, 30.0, 20.0, 1.0, 1.0, 1.0),   # 30 Apr: outside
        ("Wake", "NC", 2021, 121, 30.0, 20.0, 2.0, 2.0, 2.0),   # 1 May: inside
        ("Wake", "NC", 2021, 273, 8.0, 6.0, 3.0, 3.0, 3.0),     # 30 Sep: inside, midpoint < 10
        ("Wake", "NC", 2021, 274, 30.0, 20.0, 4.0, 4.0, 4.0),   # 1 Oct: outside
        ("Wake", "NC", 2021, 200, None, 20.0, 5.0, None, 5.0),  # NULL tmax
        ("Wake", "NC", 2020, 10, 30.0, 20.0, 6.0, 6.0, 6.0),    # January only year
        ("Wake", "NC", 2020, 122, float("nan"), 1.0, 1.0, 1.0, 1.0),  # leap-year 1 May, NaN
    ]
    from cropframe.sources import schemas
    spark.createDataFrame(days, schemas.DAILY_GRID).write.parquet(os.path.join(tmp, "grid"))
    daily = read_daily_grid(spark, os.path.join(tmp, "grid"))
    out = season.annual_features(daily, ["county", "state"], "date", "tmax", "tmin",
                                 sums={"precipitation": "prcp"},
                                 means={"vp": "vp", "srad": "srad"})
    got = {r["year"]: r for r in out.collect()}
    assert got[2021]["precipitation"] == 10.0            # 2 + 3 + 5
    assert got[2021]["avg_temp"] == (25.0 + 7.0) / 2     # NULL midpoint skipped
    assert got[2021]["gdd"] == 15.0                      # 15 + 0 (+ NULL skipped)
    assert got[2021]["vp"] == 2.5 and got[2021]["srad"] == 10.0 / 3
    assert got[2020]["precipitation"] == 1.0 and got[2020]["avg_temp"] is None
    assert got[2020]["gdd"] == 0.0


def test_daily_csv_partition_discovery(spark, tmp):
    body = "date,max_air_temperature,min_air_temperature,avg_air_temperature,precipitation\n"
    write_text(os.path.join(tmp, "d", "state=NC", "county=Wake", "year=2021", "a.csv"),
               body + "2021-05-01,30,20,26,2\n2021-10-01,30,20,25,7\n")
    write_text(os.path.join(tmp, "d", "state=NC", "county=Lee", "year=2021", "a.csv"),
               body + "2021-06-01,12,10,11,1\n")
    daily = read_daily_csv(spark, os.path.join(tmp, "d"))
    out = season.annual_features(daily, ["county", "state"], "date", "max_air_temperature",
                                 "min_air_temperature", sums={"precipitation": "precipitation"},
                                 temp_mean="avg_air_temperature")
    got = {r["county"]: (r["precipitation"], r["avg_temp"], r["gdd"]) for r in out.collect()}
    assert got == {"Wake": (2.0, 26.0, 15.0), "Lee": (1.0, 11.0, 1.0)}


SOIL = {
    "sacatalog": "areasymbol,areaname,mbrminx,mbrminy,mbrmaxx,mbrmaxy\n"
                 "NC183,\"Wake County, North Carolina\",-79,35,-78,36\n"
                 "NC105,\"Lee County, North Carolina\",-80,35,-79,36\n"
                 "NC999,\"Odd Area, North Carolina\",0,0,2,2\n",
    "legend": "areasymbol,lkey\nNC183,L1\nNC105,L2\nNC999,L3\n",
    "mapunit": "lkey,mukey,muacres\nL1,M1,100\nL1,M2,300\nL2,M3,0\nL3,M4,10\n",
    "component": "mukey,cokey,compkind,comppct_r\nM1,C1,Series,50\nM2,C2,Series,100\n"
                 "M2,C3,Taxadjunct,100\nM3,C4,Series,100\nM4,C5,Series,100\n",
    "chorizon": "cokey,hzname,ph1to1h2o_r,cec7_r,sandtotal_r,claytotal_r,om_r\n"
                "C1,Ap,6.0,10,40,20,2\nC1,A,7.0,10,40,20,2\nC1,B,9.0,10,40,20,2\n"
                "C2,A1,5.0,20,60,10,1\nC2,A,,20,60,10,1\nC3,A,1.0,1,1,1,1\n"
                "C4,A,6.0,10,40,20,2\nC5,A,6.5,10,40,20,2\n",
}


def test_soil_weighted_rules(spark, tmp):
    for name, text in SOIL.items():
        write_text(os.path.join(tmp, "soil", name, "t.csv"), text)
    tables = read_soil_tables(spark, os.path.join(tmp, "soil"))
    out = {(r["state"], r["county"]): r for r in soil.county_soil(tables).collect()}
    wake = out[("North Carolina", "Wake")]
    # C1 counted twice (Ap, A; acres 50 each), C2 once (A1; 300), NULL pH row and B dropped
    assert abs(wake["ph"] - (6.0 * 50 + 7.0 * 50 + 5.0 * 300) / 400) < 1e-12
    assert out[("North Carolina", "Lee")]["ph"] is None        # total acres 0
    assert ("North Carolina", "Odd Area, North Carolina") in out  # no ' County,'
    centres = {r["areaname"]: (r["lon"], r["lat"])
               for r in clean.box_center(tables["sacatalog"]).collect()}
    assert centres["Wake County, North Carolina"] == (-78.5, 35.5)


def test_decode_response_table(spark):
    tables = [json.dumps({"Table": [["b", "a"], ["1", "2"], ["3"]]}),
              json.dumps({"Table": [["a", "b"]]}), json.dumps({"x": 1}), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, Table string")
    got = rows(decode_response_table(df, ["a", "b", "c"], keep=["i"]), ["i", "a"])
    assert [(r["i"], r["a"], r["b"], r["c"]) for r in got] == [(0, None, "3", None),
                                                               (0, "2", "1", None)]
    assert df.select(F.lit(1)).count() == 4
