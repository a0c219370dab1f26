"""Soil features: five-table chain, area-weighted means, texture.

The chain is written with INNER joins: the row predicates on the last two
tables reject NULLs, so the reference's LEFT joins are inner in effect, and
writing them inner lets Catalyst push every predicate into its scan and
reorder/broadcast the small tables by their checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropframe.functions import nan_to_null, parse_number, safe_div

# Component kind and topsoil horizon names kept by the survey query.
SERIES_KIND = "Series"
TOPSOIL_HORIZONS = ["Ap", "A", "A1"]

# Survey column -> feature name of the area-weighted means.
SOIL_MEASURES = {
    "ph": "ph1to1h2o_r",
    "cec": "cec7_r",
    "sand_pct": "sandtotal_r",
    "clay_pct": "claytotal_r",
    "organic_matter": "om_r",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chain(tables: list[DataFrame], keys: list[str | tuple[str, str]]) -> DataFrame:
    """Inner-join ``tables`` left to right; ``keys[i]`` links table i and i+1.

    A key is a shared column name or a (left column, right column) pair.
    """
    out = tables[0]
    for right, k in zip(tables[1:], keys):
        if isinstance(k, str):
            out = out.join(right, k, "inner")
        else:
            lk, rk = k
            out = out.join(right, out[lk] == right[rk], "inner")
    return out


def soil_rows(tables: dict[str, DataFrame], kind_col: str = "compkind",
              kind: str = SERIES_KIND, horizon_col: str = "hzname",
              horizons: list[str] | None = None) -> DataFrame:
    """J4 + F10 on the survey tables: one row per (area, map unit, component, horizon).

    Text values are parsed leniently (C1); the area name and its county stay.
    """
    horizons = horizons or TOPSOIL_HORIZONS
    comp = tables["component"].filter(F.col(kind_col) == F.lit(kind))
    hor = tables["chorizon"].filter(F.col(horizon_col).isin(horizons))
    rows = chain([tables["sacatalog"].select("areasymbol", "areaname"), tables["legend"],
                  tables["mapunit"], comp, hor], ["areasymbol", "lkey", "mukey", "cokey"])
    nums = ["muacres", "comppct_r"] + list(SOIL_MEASURES.values())
    return rows.select("areasymbol", "areaname", "mukey", "cokey", kind_col, horizon_col,
                       *[parse_number(c).alias(c) for c in nums])


def component_acres(pct, acres) -> Column:
    """Comppct / 100 * muacres."""
    return _c(pct) / F.lit(100.0) * _c(acres)


def weighted_mean(df: DataFrame, keys: list[str], measures: dict[str, object], weight,
                  require: list | None = None) -> DataFrame:
    """G1: per key, sum(x * w) / sum(w) for each measure, NULL when sum(w) is 0.

    Rows with a NULL in any of ``require`` (default: every measure and the
    weight) are removed first, like a frame-wide dropna. A row that matches
    several horizons counts once per horizon, as in the reference.
    """
    w = nan_to_null(_c(weight).cast(T.DoubleType()))
    xs = {n: nan_to_null(_c(c).cast(T.DoubleType())) for n, c in measures.items()}
    req = [w] + list(xs.values()) + [_c(r) for r in (require or [])]
    cond = req[0].isNotNull()
    for r in req[1:]:
        cond = cond & r.isNotNull()
    staged = df.filter(cond).select(*keys, w.alias("_w"), *[x.alias(n) for n, x in xs.items()])
    aggs = [safe_div(F.sum(F.col(n) * F.col("_w")), F.sum("_w")).alias(n) for n in xs]
    return staged.groupBy(*keys).agg(*aggs)


def county_soil(tables: dict[str, DataFrame]) -> DataFrame:
    """Survey tables -> one row of soil features per area (county, state)."""
    from cropframe.functions import county_name
    rows = soil_rows(tables)
    rows = rows.withColumn("county", county_name("areaname")).withColumn(
        "state", F.trim(F.substring_index("areaname", ",", -1)))
    return weighted_mean(rows, ["state", "county"], SOIL_MEASURES,
                         component_acres("comppct_r", "muacres"))


def texture_fractions(df: DataFrame, sand, clay, silt=None, keep: list | None = None) -> DataFrame:
    """Sand, silt, clay as fractions of their total.

    Without a silt column, silt = 100 - sand - clay (percent scale), so the
    total is 100. A zero or NULL total gives NULL fractions.
    """
    s, c = _c(sand).cast("double"), _c(clay).cast("double")
    si = (F.lit(100.0) - s - c) if silt is None else _c(silt).cast("double")
    total = s + si + c
    return df.select(*[_c(k) for k in (keep or [])],
                     safe_div(s, total).alias("sand_frac"),
                     safe_div(si, total).alias("silt_frac"),
                     safe_div(c, total).alias("clay_frac"))
