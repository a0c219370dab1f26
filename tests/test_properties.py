import os

from hypothesis import given, settings
from hypothesis import strategies as st

from cropframe.operators import gaps
from cropframe.sources import read_table


def _ranges_reference(years):
    """Plain-Python contiguous ranges of a sorted year list."""
    out = []
    for y in sorted(set(years)):
        if out and y == out[-1][1] + 1:
            out[-1][1] = y
        else:
            out.append([y, y])
    return [tuple(r) for r in out]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=1980, max_value=2024), max_size=30))
def test_year_ranges_match_reference(spark, years):
    df = spark.createDataFrame([(1, y) for y in years], "k int, year int")
    got = sorted((r["range_start"], r["range_end"])
                 for r in gaps.year_ranges(df.distinct(), ["k"]).collect())
    assert got == _ranges_reference(years)


def test_read_table_projects_final_schema(spark, tmp):
    path = os.path.join(tmp, "weather_old")
    spark.createDataFrame(
        [("Wake", "NC", 2000, 7, 20.0, 1.0, 30.0, 10.0, 5.0)],
        "county string, state string, year int, month int, avg_temp double, "
        "precipitation double, max_temp double, min_temp double, gdd double"
    ).write.parquet(path)
    df = read_table(spark, path, "weather")
    assert df.columns == ["county", "state", "year", "avg_temp", "precipitation", "vp", "srad",
                          "gdd"]
    r = df.first()
    assert r["vp"] is None and r["gdd"] == 5.0
