"""Declared schemas: stored tables and landed inputs. Nothing is inferred."""

from pyspark.sql import types as T

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()


def _struct(*fields, nullable=True):
    return T.StructType([T.StructField(n, t, nullable) for n, t in fields])


# Stored tables (final state after all schema migrations); the natural key is
# the identity, no surrogate id is produced.
YIELDS = _struct(("year", I), ("state", S), ("district", S), ("county", S),
                 ("county_ansi", S), ("crop", S), ("value", D), ("unit", S))
WEATHER = _struct(("county", S), ("state", S), ("year", I), ("avg_temp", D),
                  ("precipitation", D), ("vp", D), ("srad", D), ("gdd", D))
SOIL = _struct(("county", S), ("state", S), ("ph", D), ("organic_matter", D),
               ("sand_pct", D), ("clay_pct", D))

STORED = {"yields": YIELDS, "weather": WEATHER, "soil": SOIL}

# Natural keys used by the upserts.
YIELD_KEY = ["year", "county", "state", "crop"]
WEATHER_KEY = ["year", "county", "state"]
SOIL_KEY = ["county", "state"]

# Landed yield CSV: every column read as text, parsed afterwards.
YIELD_CSV = _struct(("State", S), ("County", S), ("Year", S), ("Commodity", S),
                    ("Data Item", S), ("Value", S), ("Ag District", S), ("County ANSI", S))

# Landed yield records: one response object per file, rows under `data`.
YIELD_RECORD = _struct(("year", S), ("Value", S), ("commodity_desc", S), ("asd_desc", S),
                       ("county_ansi", S), ("unit_desc", S), ("county_name", S),
                       ("state_name", S), ("source_desc", S), ("sector_desc", S),
                       ("group_desc", S), ("statisticcat_desc", S), ("agg_level_desc", S))
# What the yield request asks the service for.
SERVICE_FILTER = {
    "source_desc": "SURVEY", "sector_desc": "CROPS", "group_desc": "FIELD CROPS",
    "statisticcat_desc": "YIELD", "unit_desc": "BU / ACRE", "agg_level_desc": "COUNTY",
}
# Record columns that a file may lack as a whole.
OPTIONAL_RECORD = ["commodity_desc", "asd_desc", "county_ansi", "unit_desc"]
YIELD_JSON = T.StructType([T.StructField("data", T.ArrayType(YIELD_RECORD), True)])

# Daily climate, grid-service frame (one row per county-day).
DAILY_GRID = _struct(("county", S), ("state", S), ("year", I), ("yday", I), ("tmax", D),
                     ("tmin", D), ("prcp", D), ("vp", D), ("srad", D))

# Daily climate, CSV service (county/state/year come from the landing path).
DAILY_CSV = _struct(("date", S), ("max_air_temperature", D), ("min_air_temperature", D),
                    ("avg_air_temperature", D), ("precipitation", D))

# Soil survey tables; the service returns every value as text.
SOIL_TABLES = {
    "sacatalog": ["areasymbol", "areaname", "mbrminx", "mbrminy", "mbrmaxx", "mbrmaxy"],
    "legend": ["areasymbol", "lkey"],
    "mapunit": ["lkey", "mukey", "muacres"],
    "component": ["mukey", "cokey", "compkind", "comppct_r"],
    "chorizon": ["cokey", "hzname", "ph1to1h2o_r", "cec7_r", "sandtotal_r", "claytotal_r",
                 "om_r"],
}

# Response object of the soil service: {"Table": [[header...], [row...], ...]}.
RESPONSE_TABLE = T.StructType([T.StructField("Table", T.ArrayType(T.ArrayType(S)), True)])
