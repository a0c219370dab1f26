import datetime as dt

from pyspark.sql import functions as F

from cropframe.functions import (county_name, day_of_year_date, degree_days, first_truthy,
                                 parse_number, plain_code)


def test_parse_number_lenient(spark):
    vals = ["45.2", " 45.2 ", "1,234", "(D)", "", "45d", "nan", None, "-3e2", ".5"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(parse_number("v")).collect()]
    assert got == [45.2, 45.2, None, None, None, None, None, None, -300.0, 0.5]
    got2 = [r[0] for r in df.select(parse_number("v", strip_thousands=True)).collect()]
    assert got2[2] == 1234.0


def test_degree_days_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (15.0,)], "t double")
    assert [r[0] for r in df.select(degree_days("t")).collect()] == [None, 0.0, 5.0]


def test_day_of_year_date(spark):
    df = spark.createDataFrame([(2021, 60), (2020, 60), (2020, 366)], "y int, d int")
    got = [r[0] for r in df.select(day_of_year_date("y", "d")).collect()]
    assert got == [dt.date(2021, 3, 1), dt.date(2020, 2, 29), dt.date(2020, 12, 31)]


def test_text_helpers(spark):
    df = spark.createDataFrame([("Wake County, North Carolina", "37.0", "", "bu"),
                                ("Carteret, North Carolina", None, "YIELD", None)],
                               "a string, c string, d string, u string")
    got = df.select(county_name("a"), plain_code("c"), first_truthy("d", "u")).collect()
    assert [tuple(r) for r in got] == [("Wake", "37", "bu"),
                                       ("Carteret, North Carolina", None, "YIELD")]
    assert df.select(F.lit(1)).count() == 2
