"""DuckDB SQL equivalents of the stand-in queries (the correctness oracle).

Written independently of the Spark code: each string is plain SQL over the
driver's tables. Doubles are rounded to the same digits as the Spark side.
"""

from __future__ import annotations

SEASON = "month(l_shipdate) BETWEEN 5 AND 9"

ORACLE: dict[str, str] = {}

ORACLE["q_season"] = f"""
SELECT l_suppkey,
       CAST(year(l_shipdate) AS INTEGER) AS year,
       round(coalesce(sum(CASE WHEN {SEASON} THEN l_extendedprice END), 0.0), 6) + 0.0 AS precipitation,
       round(avg(CASE WHEN {SEASON} THEN (l_quantity + l_tax) / 2 END), 6) + 0.0 AS avg_temp,
       round(coalesce(sum(CASE WHEN {SEASON} THEN greatest((l_quantity + l_tax) / 2 - 10.0, 0.0) END), 0.0), 6) + 0.0 AS gdd,
       round(avg(CASE WHEN {SEASON} THEN l_discount END), 6) + 0.0 AS vp,
       round(avg(CASE WHEN {SEASON} THEN l_tax END), 6) + 0.0 AS srad
FROM lineitem
GROUP BY l_suppkey, year(l_shipdate)
"""

ORACLE["q_season_simple"] = f"""
SELECT l_suppkey,
       CAST(year(l_shipdate) AS INTEGER) AS year,
       round(coalesce(sum(CASE WHEN {SEASON} THEN l_extendedprice END), 0.0), 6) + 0.0 AS precipitation,
       round(avg(CASE WHEN {SEASON} THEN l_discount END), 6) + 0.0 AS avg_temp,
       round(coalesce(sum(CASE WHEN {SEASON} THEN greatest((l_quantity + l_tax) / 2 - 10.0, 0.0) END), 0.0), 6) + 0.0 AS gdd
FROM (SELECT l_suppkey, l_shipdate, l_quantity, l_tax, l_extendedprice, l_discount
      FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01'
      UNION ALL
      SELECT l_suppkey, l_shipdate, l_quantity, l_tax, l_extendedprice, l_discount
      FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')
GROUP BY l_suppkey, year(l_shipdate)
"""

ORACLE["q_cum_gdd"] = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS t
           FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT user_id, date, CAST(year(date) AS INTEGER) AS year,
       round(greatest(t - 10.0, 0.0), 6) + 0.0 AS gdd,
       round(sum(greatest(t - 10.0, 0.0)) OVER (PARTITION BY user_id, year(date) ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS cum_gdd
FROM d
"""

SOIL_CTE = """
soil AS (
  SELECT state, county,
         sum(l_discount * w) / nullif(sum(w), 0) AS ph,
         sum(l_tax * w) / nullif(sum(w), 0) AS organic_matter,
         sum(l_quantity * w) / nullif(sum(w), 0) AS sand_pct,
         sum(CAST(p_size AS DOUBLE) * w) / nullif(sum(w), 0) AS clay_pct
  FROM (SELECT r.r_name AS state, n.n_name AS county, l.l_discount, l.l_tax, l.l_quantity,
               p.p_size, l.l_quantity / 100.0 * p.p_retailprice AS w
        FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey
        JOIN supplier s ON n.n_nationkey = s.s_nationkey
        JOIN lineitem l ON s.s_suppkey = l.l_suppkey
        JOIN part p ON l.l_partkey = p.p_partkey
        WHERE l.l_returnflag = 'N' AND p.p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))
  GROUP BY state, county)
"""

YIELDS_CTE = """
yields AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year, r.r_name AS state,
         'AD' || right(n.n_name, 1) AS district, n.n_name AS county,
         CAST(n.n_nationkey AS VARCHAR) AS county_ansi, o.o_orderpriority AS crop,
         avg(o.o_totalprice) AS value, 'BU / ACRE' AS unit
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY year(o.o_orderdate), r.r_name, n.n_name, n.n_nationkey, o.o_orderpriority)
"""

WEATHER_CTE = f"""
weather AS (
  SELECT n.n_name AS county, r.r_name AS state, CAST(year(l.l_shipdate) AS INTEGER) AS year,
         avg(CASE WHEN {SEASON} THEN (l_quantity + l_tax) / 2 END) AS avg_temp,
         coalesce(sum(CASE WHEN {SEASON} THEN l_extendedprice END), 0.0) AS precipitation,
         avg(CASE WHEN {SEASON} THEN l_discount END) AS vp,
         avg(CASE WHEN {SEASON} THEN l_tax END) AS srad,
         coalesce(sum(CASE WHEN {SEASON} THEN greatest((l_quantity + l_tax) / 2 - 10.0, 0.0) END), 0.0) AS gdd
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY n.n_name, r.r_name, year(l.l_shipdate))
"""

WITH_ALL = f"WITH {YIELDS_CTE}, {WEATHER_CTE}, {SOIL_CTE}"


def r6(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) + 0.0 AS {alias or c.split('.')[-1]}"


FRAME_SELECT = ", ".join([
    "y.year", "y.state", "y.district", "y.county", "y.county_ansi", "y.crop",
    r6("y.value", "yield"), "y.unit", r6("w.avg_temp"), r6("w.precipitation"), r6("w.vp"),
    r6("w.srad"), r6("w.gdd"), r6("s.ph"), r6("s.organic_matter"), r6("s.sand_pct"),
    r6("s.clay_pct")])

FRAME_FROM = """
FROM yields y
LEFT JOIN weather w ON y.state = w.state AND y.county = w.county AND y.year = w.year
LEFT JOIN soil s ON y.state = s.state AND y.county = s.county
"""

NOT_SENTINEL = "(y.county IS NULL OR y.county NOT IN ('OTHER (COMBINED) COUNTIES', 'OTHER COUNTIES'))"

ORACLE["q_weighted"] = f"""WITH {SOIL_CTE}
SELECT state, county, {r6('ph')}, {r6('organic_matter')}, {r6('sand_pct')}, {r6('clay_pct')}
FROM soil"""

ORACLE["q_texture"] = """
SELECT l_orderkey, l_linenumber,
       round(l_quantity / (l_quantity + l_tax * 100 + l_discount * 100), 6) + 0.0 AS sand_frac,
       round(l_tax * 100 / (l_quantity + l_tax * 100 + l_discount * 100), 6) + 0.0 AS silt_frac,
       round(l_discount * 100 / (l_quantity + l_tax * 100 + l_discount * 100), 6) + 0.0 AS clay_frac
FROM lineitem
"""

ORACLE["q_frame"] = f"{WITH_ALL} SELECT {FRAME_SELECT} {FRAME_FROM} WHERE {NOT_SENTINEL}"

KEYED_CTE = f"""
yields AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, 'ALL' AS state, 'AD' || (o_custkey % 10) AS district,
         'C' || o_custkey AS county, CAST(o_custkey AS VARCHAR) AS county_ansi, o_orderpriority AS crop,
         avg(o_totalprice) AS value, 'BU / ACRE' AS unit
  FROM orders GROUP BY year(o_orderdate), o_custkey, o_orderpriority),
weather AS (
  SELECT 'C' || l_suppkey AS county, 'ALL' AS state, CAST(year(l_shipdate) AS INTEGER) AS year,
         avg(CASE WHEN {SEASON} THEN (l_quantity + l_tax) / 2 END) AS avg_temp,
         coalesce(sum(CASE WHEN {SEASON} THEN l_extendedprice END), 0.0) AS precipitation,
         avg(CASE WHEN {SEASON} THEN l_discount END) AS vp, avg(CASE WHEN {SEASON} THEN l_tax END) AS srad,
         coalesce(sum(CASE WHEN {SEASON} THEN greatest((l_quantity + l_tax) / 2 - 10.0, 0.0) END), 0.0) AS gdd
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate)),
soil AS (
  SELECT 'ALL' AS state, 'C' || l_partkey AS county, sum(l_discount * w) / nullif(sum(w), 0) AS ph,
         sum(l_tax * w) / nullif(sum(w), 0) AS organic_matter, sum(l_quantity * w) / nullif(sum(w), 0) AS sand_pct,
         sum(CAST(p_size AS DOUBLE) * w) / nullif(sum(w), 0) AS clay_pct
  FROM (SELECT *, l_quantity / 100.0 * p_retailprice AS w FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))
  GROUP BY l_partkey)
"""

ORACLE["q_unmatched"] = f"""WITH {KEYED_CTE},
j AS (SELECT y.*, w.year IS NOT NULL AS has_w, s.state IS NOT NULL AS has_s {FRAME_FROM})
SELECT 'yield_rows' AS metric, CAST(count(*) AS BIGINT) AS n FROM j
UNION ALL SELECT 'no_weather', CAST(count(*) FILTER (WHERE NOT has_w) AS BIGINT) FROM j
UNION ALL SELECT 'no_soil', CAST(count(*) FILTER (WHERE NOT has_s) AS BIGINT) FROM j
UNION ALL SELECT 'weather_rows', CAST(count(*) AS BIGINT) FROM weather
UNION ALL SELECT 'soil_rows', CAST(count(*) AS BIGINT) FROM soil
"""

ORACLE["q_unmatched_rows"] = f"WITH {KEYED_CTE} SELECT {FRAME_SELECT} {FRAME_FROM} WHERE w.year IS NULL"

ORACLE["q_scope"] = f"""{WITH_ALL}
SELECT y.year, y.state, y.county, y.crop, {r6('y.value', 'yield')}, {r6('w.avg_temp')},
       {r6('w.precipitation')}, {r6('w.vp')}, {r6('w.srad')}, {r6('w.gdd')}, {r6('s.ph')},
       {r6('s.organic_matter')}, {r6('s.sand_pct')}, {r6('s.clay_pct')}
{FRAME_FROM} WHERE {NOT_SENTINEL} AND y.district IN ('AD1', 'AD3')
"""

ORACLE["q_pick"] = f"""{WITH_ALL}
SELECT {FRAME_SELECT} {FRAME_FROM}
WHERE {NOT_SENTINEL} AND y.county = 'NATION_3' AND y.year = 1997
ORDER BY y.county, y.year, y.crop LIMIT 1
"""

ORACLE["q_yield_query"] = f"""WITH {YIELDS_CTE}
SELECT year, state, district, county, county_ansi, crop, {r6('value')}, unit FROM yields
WHERE state = 'AMERICA' AND crop = '1-URGENT' AND year >= 1996 AND year <= 2000
"""

ORACLE["q_weather_query"] = f"""WITH {WEATHER_CTE}
SELECT county, state, year, {r6('avg_temp')}, {r6('precipitation')}, {r6('vp')}, {r6('srad')},
       {r6('gdd')}
FROM weather WHERE state = 'EUROPE' AND year = 1998
"""

ORACLE["q_soil_query"] = f"""WITH {SOIL_CTE}
SELECT state, county, {r6('ph')}, {r6('organic_matter')}, {r6('sand_pct')}, {r6('clay_pct')}
FROM soil WHERE state = 'ASIA'
"""

ORACLE["q_crop_list"] = """
SELECT DISTINCT upper(o_orderpriority) AS crop FROM orders WHERE o_orderpriority IS NOT NULL
"""

ORACLE["q_year_counts"] = f"""WITH {YIELDS_CTE}
SELECT county, CAST(count(DISTINCT year) AS BIGINT) AS n_years FROM yields GROUP BY county
"""

ORACLE["q_span"] = """
SELECT trim(n.n_name) AS county, trim(r.r_name) AS state,
       CAST(min(year(o.o_orderdate)) AS INTEGER) AS start_year,
       CAST(max(year(o.o_orderdate)) AS INTEGER) AS end_year
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE o.o_orderdate IS NOT NULL
GROUP BY trim(n.n_name), trim(r.r_name)
"""

ORACLE["q_head_tail"] = f"""WITH {YIELDS_CTE}
SELECT * FROM (SELECT year, state, district, county, county_ansi, crop, {r6('value')}, unit,
                      'head' AS part
               FROM yields ORDER BY state, county, year, crop LIMIT 5)
UNION ALL
SELECT * FROM (SELECT year, state, district, county, county_ansi, crop, {r6('value')}, unit,
                      'tail' AS part
               FROM yields ORDER BY state DESC, county DESC, year DESC, crop DESC LIMIT 5)
"""

NUM_RE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parse_sql(expr: str) -> str:
    return f"(CASE WHEN regexp_full_match({expr}, '{NUM_RE}') THEN TRY_CAST(trim({expr}) AS DOUBLE) END)"


ORACLE["q_clean_numeric"] = f"""
WITH li AS (SELECT l_orderkey, l_linenumber, format('{{:,.2f}}', l_extendedprice) AS raw FROM lineitem),
u AS (
  SELECT 'props' AS source, event_id AS id, CAST(NULL AS INTEGER) AS line,
         {parse_sql("regexp_extract(props, ':([^}]*)', 1)")} AS value FROM events
  UNION ALL
  SELECT 'price_strip', l_orderkey, l_linenumber, {parse_sql("replace(raw, ',', '')")} FROM li
  UNION ALL
  SELECT 'price_plain', l_orderkey, l_linenumber, {parse_sql("raw")} FROM li)
SELECT source, id, line, round(value, 6) + 0.0 AS value FROM u WHERE value IS NOT NULL
"""

ORACLE["q_clean_names"] = """
WITH j AS (
  SELECT n.n_nationkey AS areasymbol,
         CASE WHEN r.r_name = 'MIDDLE EAST' THEN n.n_name || ', ' || r.r_name
              ELSE n.n_name || ' County, ' || r.r_name END AS areaname,
         r.r_name AS state, '  ' || lower(n.n_name) || ' ' AS padded
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT areasymbol, areaname, state,
       CASE WHEN strpos(areaname, ' County,') > 0
            THEN substr(areaname, 1, strpos(areaname, ' County,') - 1) ELSE areaname END AS county,
       upper(trim(padded)) AS key, ends_with(areaname, ', AMERICA') AS in_america
FROM j
"""

ORACLE["q_dates"] = """
WITH d AS (SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INTEGER) AS year,
                  CAST(dayofyear(l_shipdate) AS INTEGER) AS yday, CAST(l_shipdate AS DATE) AS ship
           FROM lineitem)
SELECT l_orderkey, l_linenumber, year, yday, make_date(year, 1, 1) + (yday - 1) AS date,
       CAST(month(make_date(year, 1, 1) + (yday - 1)) AS INTEGER) AS month,
       (make_date(year, 1, 1) + (yday - 1)) = ship AS same
FROM d
"""

ORACLE["q_box_center"] = """
WITH c AS (
  SELECT n.n_name || ' County, ' || r.r_name AS areaname,
         CAST(n.n_nationkey AS VARCHAR) || CASE WHEN s.s_acctbal >= 0 THEN '-P' ELSE '-N' END AS areasymbol,
         min(s.s_acctbal) AS mbrminx, max(s.s_acctbal) AS mbrmaxx,
         CAST(min(s.s_suppkey) AS DOUBLE) AS mbrminy, CAST(max(s.s_suppkey) AS DOUBLE) AS mbrmaxy
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2),
f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY areaname ORDER BY areasymbol) = 1)
SELECT areaname, round((mbrminx + mbrmaxx) / 2, 6) + 0.0 AS lon,
       round((mbrminy + mbrmaxy) / 2, 6) + 0.0 AS lat
FROM f
"""

ORACLE["q_yield_rows"] = f"""
WITH csv AS (
  SELECT ' ' || lower(r.r_name) || ' ' AS "State", n.n_name AS "County",
         CAST(year(o.o_orderdate) AS VARCHAR) AS "Year", o.o_orderpriority AS "Commodity",
         CASE o.o_orderstatus WHEN 'F' THEN o.o_orderpriority || ' - YIELD, MEASURED IN BU / ACRE'
                              WHEN 'O' THEN o.o_orderpriority || ' - PRODUCTION'
                              ELSE lower(o.o_orderpriority) || ' - yield' END AS "Data Item",
         CASE WHEN o.o_orderstatus = 'P' THEN format('{{:,.2f}}', o.o_totalprice)
              ELSE CAST(o.o_totalprice AS VARCHAR) END AS "Value",
         c.c_mktsegment AS "Ag District", CAST(c.c_nationkey AS VARCHAR) AS "County ANSI"
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
req AS (SELECT DISTINCT upper(trim(n.n_name)) AS rc, upper(trim(lower(r.r_name))) AS rs
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'AMERICA'),
kept AS (
  SELECT * FROM csv
  WHERE coalesce(contains(upper("Data Item"), 'YIELD'), false)
    AND TRY_CAST("Year" AS INTEGER) BETWEEN 1996 AND 2000
    AND EXISTS (SELECT 1 FROM req WHERE req.rc = upper(trim(csv."County"))
                                   AND req.rs = upper(trim(csv."State"))))
SELECT TRY_CAST("Year" AS INTEGER) AS year, trim("State") AS state, trim("County") AS county,
       round({parse_sql('"Value"')}, 6) + 0.0 AS value, "Commodity" AS crop,
       nullif("Data Item", '') AS unit, "Ag District" AS district, "County ANSI" AS county_ansi
FROM kept WHERE {parse_sql('"Value"')} IS NOT NULL
"""

ORACLE["q_catalog_join"] = """
WITH cat AS (SELECT n.n_nationkey AS areasymbol, n.n_name || ' County, ' || r.r_name AS areaname
             FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
cat_s AS (SELECT * FROM cat WHERE ends_with(areaname, ', EUROPE')),
k AS (SELECT o.o_orderkey, lower(n.n_name) AS county, r.r_name AS state
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN nation n ON c.c_nationkey = n.n_nationkey
      JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT k.o_orderkey, cat_s.areasymbol, k.county AS order_county, cat_s.areaname
FROM k JOIN cat_s ON lower(k.county || ' County, ' || k.state) = lower(cat_s.areaname)
"""

GAPS_SQL = """
keys AS (SELECT DISTINCT o_custkey FROM {src}),
wanted AS (SELECT o_custkey, CAST(y AS INTEGER) AS year FROM keys, range({first}, 2002) t(y)),
present AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM {src}
            WHERE year(o_orderdate) BETWEEN {first} AND 2001),
missing AS (SELECT * FROM wanted w WHERE NOT EXISTS
            (SELECT 1 FROM present p WHERE p.o_custkey = w.o_custkey AND p.year = w.year)),
g AS (SELECT o_custkey, year, year - row_number() OVER (PARTITION BY o_custkey ORDER BY year) AS grp
      FROM missing),
ranges AS (SELECT o_custkey, CAST(min(year) AS INTEGER) AS range_start,
                  CAST(max(year) AS INTEGER) AS range_end FROM g GROUP BY o_custkey, grp)
"""

ORACLE["q_gaps"] = "WITH " + GAPS_SQL.format(src="orders", first=1995) + " SELECT * FROM ranges"

ORACLE["q_keep_missing"] = """WITH tgt AS (SELECT o_custkey, l_shipdate AS o_orderdate
             FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
""" + GAPS_SQL.format(src="tgt", first=1992) + """
SELECT o.o_orderkey, o.o_custkey, CAST(year(o.o_orderdate) AS INTEGER) AS year, o.o_orderpriority,
       round(o.o_totalprice, 6) + 0.0 AS o_totalprice
FROM orders o
WHERE o.o_orderpriority = '1-URGENT'
  AND EXISTS (SELECT 1 FROM ranges r WHERE r.o_custkey = o.o_custkey
              AND year(o.o_orderdate) BETWEEN r.range_start AND r.range_end)
"""

LAST_ORDER = "ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC"
LI_PART = f"OVER (PARTITION BY l_orderkey, l_linenumber {LAST_ORDER})"
LI_COLS = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
           "l_discount, l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate")

ORACLE["q_upsert_batch"] = f"""
WITH t AS (SELECT {LI_COLS} FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
           QUALIFY row_number() {LI_PART} = 1),
b AS (SELECT {LI_COLS} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'
      QUALIFY row_number() {LI_PART} = 1),
u AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = t.l_orderkey
                                        AND b.l_linenumber = t.l_linenumber)
      UNION ALL SELECT * FROM b)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       round(l_quantity, 6) + 0.0 AS l_quantity, round(l_extendedprice, 6) + 0.0 AS l_extendedprice,
       round(l_discount, 6) + 0.0 AS l_discount, round(l_tax, 6) + 0.0 AS l_tax,
       l_returnflag, l_linestatus, l_shipdate
FROM u
"""

ORACLE["q_upsert_narrow"] = f"""
WITH t AS (SELECT {LI_COLS} FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
           QUALIFY row_number() {LI_PART} = 1),
b AS (SELECT {LI_COLS} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'
      QUALIFY row_number() {LI_PART} = 1)
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) + 0.0 AS l_quantity,
       round(l_extendedprice, 6) + 0.0 AS l_extendedprice, round(l_discount, 6) + 0.0 AS l_discount,
       round(l_tax, 6) + 0.0 AS l_tax
FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = t.l_orderkey AND b.l_linenumber = t.l_linenumber)
UNION ALL
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) + 0.0, round(l_extendedprice, 6) + 0.0, NULL, NULL FROM b
"""

ORACLE["q_records_filter"] = """
WITH f AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN 'AD' END AS d1,
                  CASE WHEN o_orderkey % 2 = 1 THEN 'AD' END AS d2 FROM orders)
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, 'S' AS state, 'C' || CAST(o_custkey % 10 AS VARCHAR) AS county,
       round(o_totalprice, 2) + 0.0 AS value, o_orderpriority AS crop, 'BU / ACRE' AS unit, d1 AS district,
       CAST(o_custkey % 100 AS VARCHAR) AS county_ansi, CAST(o_orderkey AS VARCHAR) AS src_file,
       CAST(0 AS INTEGER) AS src_row
FROM f WHERE o_orderkey % 3 <> 0 AND (d1 IS NOT NULL OR d2 IS NULL)
"""

ORACLE["q_backfill"] = f"""WITH {YIELDS_CTE}
SELECT year, state, district, county, county_ansi, crop, {r6('value')}, unit FROM yields
WHERE state IN ('AMERICA', 'EUROPE') AND crop = '1-URGENT' AND year BETWEEN 1992 AND 1998
"""

ORACLE["q_upsert_merge"] = f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag AS flag,
                  l_linestatus AS status
           FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
           QUALIFY row_number() {LI_PART} = 1),
src AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_partkey,
               l_suppkey, nullif(l_returnflag, 'N') AS flag, nullif(l_linestatus, 'O') AS status
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'),
bl AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM src
       QUALIFY row_number() {LI_PART} = 1),
bk AS (SELECT l_orderkey, l_linenumber,
              (array_agg(flag {LAST_ORDER}) FILTER (WHERE flag IS NOT NULL))[1] AS flag,
              (array_agg(status {LAST_ORDER}) FILTER (WHERE status IS NOT NULL))[1] AS status
       FROM src GROUP BY l_orderkey, l_linenumber),
b AS (SELECT * FROM bl JOIN bk USING (l_orderkey, l_linenumber))
SELECT coalesce(b.l_orderkey, t.l_orderkey) AS l_orderkey,
       coalesce(b.l_linenumber, t.l_linenumber) AS l_linenumber,
       round(CASE WHEN b.l_orderkey IS NOT NULL THEN b.l_quantity ELSE t.l_quantity END, 6) + 0.0 AS l_quantity,
       round(CASE WHEN b.l_orderkey IS NOT NULL THEN b.l_extendedprice ELSE t.l_extendedprice END, 6) + 0.0 AS l_extendedprice,
       coalesce(b.flag, t.flag) AS flag, coalesce(b.status, t.status) AS status
FROM t FULL OUTER JOIN b ON t.l_orderkey = b.l_orderkey AND t.l_linenumber = b.l_linenumber
"""

# --------------------------------------------------------------------------- profile
NUM_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def long_sql(table: str, cols: list[str], cast: str = "DOUBLE") -> str:
    zero = " + 0.0" if cast == "DOUBLE" else ""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS {cast}){zero} AS value FROM {table}" for c in cols)


ORACLE["q_overview"] = f"""
WITH a AS (SELECT count(*) AS n, {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in LI_ALL)} AS miss
           FROM lineitem),
d AS (SELECT count(*) AS dn FROM (SELECT DISTINCT * FROM lineitem))
SELECT 'rows' AS metric, CAST(n AS DOUBLE) AS value FROM a
UNION ALL SELECT 'columns', {float(len(LI_ALL))} FROM a
UNION ALL SELECT 'missing_cells', CAST(miss AS DOUBLE) FROM a
UNION ALL SELECT 'missing_share', round(miss / (n * {float(len(LI_ALL))}), 6) + 0.0 FROM a
UNION ALL SELECT 'duplicate_rows', CAST(n - dn AS DOUBLE) FROM a, d
"""

PROBS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}

ORACLE["q_profile_num"] = f"""
WITH l AS ({long_sql('lineitem', NUM_COLS)}),
med AS (SELECT feature, quantile_cont(value, 0.5) AS m FROM l GROUP BY feature)
SELECT l.feature, count(value) AS count, count(*) FILTER (WHERE value IS NULL) AS missing,
       count(DISTINCT value) AS distinct, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')},
       {r6('var_samp(value)', 'variance')}, {r6('min(value)', 'min')}, {r6('max(value)', 'max')},
       {r6('sum(value)', 'sum')}, count(*) FILTER (WHERE value = 0) AS zeros,
       count(*) FILTER (WHERE value < 0) AS negatives, {r6('skewness(value)', 'skewness')},
       {r6('kurtosis(value)', 'kurtosis')},
       {', '.join(r6(f'quantile_cont(value, {p})', k) for k, p in PROBS.items())},
       {r6('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr')},
       {r6('quantile_cont(abs(value - med.m), 0.5)', 'mad')}
FROM l JOIN med ON l.feature = med.feature
GROUP BY l.feature
"""

CAT_COLS = ["p_name", "p_brand", "p_type"]

ORACLE["q_profile_cat"] = f"""
WITH l AS ({long_sql('part', CAT_COLS, 'VARCHAR')})
SELECT feature, count(value) AS count, count(*) FILTER (WHERE value IS NULL) AS missing,
       count(DISTINCT value) AS distinct, CAST(min(length(value)) AS INTEGER) AS min_length,
       {r6('avg(length(value))', 'mean_length')}, CAST(max(length(value)) AS INTEGER) AS max_length
FROM l GROUP BY feature
"""

ORACLE["q_top_values"] = f"""
WITH l AS ({long_sql('part', CAT_COLS, 'VARCHAR')}),
vc AS (SELECT feature, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY feature, value)
SELECT feature, value, count,
       CAST(row_number() OVER (PARTITION BY feature ORDER BY count DESC, value) AS INTEGER) AS rank
FROM vc QUALIFY rank <= 5
"""

ORACLE["q_hist"] = f"""
WITH l AS ({long_sql('lineitem', NUM_COLS)}),
r AS (SELECT feature, min(value) AS mn, max(value) AS mx FROM l WHERE value IS NOT NULL GROUP BY feature),
b AS (SELECT l.feature, mn, mx, (mx - mn) / 10.0 AS w,
             CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((value - mn) / ((mx - mn) / 10.0)), 9) END AS INTEGER) AS bin
      FROM l JOIN r ON l.feature = r.feature WHERE value IS NOT NULL)
SELECT feature, bin, {r6('mn + bin * w', 'lo')},
       {r6('CASE WHEN bin = 9 THEN mx ELSE mn + (bin + 1) * w END', 'hi')}, count(*) AS count
FROM b GROUP BY feature, bin, mn, mx, w
"""

NULLABLE = """(SELECT l_quantity, nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax,
                      nullif(l_returnflag, 'N') AS l_returnflag FROM lineitem)"""
NULL_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]

ORACLE["q_nullity"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) + 0.0 AS share FROM {NULLABLE}"
    for c in NULL_COLS)

ORACLE["q_nullity_corr"] = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN var_pop(CAST({a} IS NULL AS DOUBLE)) = 0 OR var_pop(CAST({b} IS NULL AS DOUBLE)) = 0 THEN NULL ELSE corr(CAST({a} IS NULL AS DOUBLE), CAST({b} IS NULL AS DOUBLE)) END, 6) + 0.0 AS r FROM {NULLABLE}"
    for i, a in enumerate(NULL_COLS) for b in NULL_COLS[i + 1:])

ORACLE["q_pearson"] = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem"
    for i, a in enumerate(NUM_COLS) for b in NUM_COLS[i + 1:])


def spearman_sql(src: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS x, '{b}' AS y, round(corr(ra, rb), 6) + 0.0 AS r FROM (
  SELECT rank() OVER (ORDER BY va) + (count(*) OVER (PARTITION BY va) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY vb) + (count(*) OVER (PARTITION BY vb) - 1) / 2.0 AS rb
  FROM (SELECT CAST({a} AS DOUBLE) + 0.0 AS va, CAST({b} AS DOUBLE) + 0.0 AS vb FROM {src}
        WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""


RANK_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
ORACLE["q_spearman"] = " UNION ALL ".join(
    spearman_sql("lineitem", a, b) for i, a in enumerate(RANK_COLS) for b in RANK_COLS[i + 1:])

ORACLE["q_kendall"] = """
WITH p AS (SELECT CAST(l_linenumber AS DOUBLE) AS x, CAST(round(l_discount * 100) AS INTEGER) AS y,
                  count(*) AS c FROM lineitem GROUP BY 1, 2),
s AS (SELECT sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM p a, p b),
n AS (SELECT sum(c) AS n FROM p),
tx AS (SELECT sum(t * (t - 1) / 2) AS v FROM (SELECT sum(c) AS t FROM p GROUP BY x)),
ty AS (SELECT sum(t * (t - 1) / 2) AS v FROM (SELECT sum(c) AS t FROM p GROUP BY y))
SELECT 'l_linenumber' AS x, 'discount_pct' AS y,
       round(s.s / sqrt((n.n * (n.n - 1) / 2 - tx.v) * (n.n * (n.n - 1) / 2 - ty.v)), 6) + 0.0 AS tau
FROM s, n, tx, ty
"""


def chi_sql(src: str, a: str, b: str, correction: bool = True) -> str:
    return f"""(WITH d AS (SELECT {a} AS xa, {b} AS xb FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
cells AS (SELECT xa, xb, CAST(count(*) AS DOUBLE) AS o FROM d GROUP BY xa, xb),
rx AS (SELECT xa, sum(o) AS ri FROM cells GROUP BY xa),
cy AS (SELECT xb, sum(o) AS cj FROM cells GROUP BY xb),
n AS (SELECT sum(o) AS n FROM cells),
e AS (SELECT cells.xa, cells.xb, o, ri, cj, n FROM cells JOIN rx USING (xa) JOIN cy USING (xb), n),
t AS (SELECT (SELECT count(*) FROM rx) AS r, (SELECT count(*) FROM cy) AS k, max(n) AS n,
             sum((o - ri * cj / n) * (o - ri * cj / n) / (ri * cj / n)) AS plain,
             max(abs(o - ri * cj / n)) AS dev FROM e),
c AS (SELECT *, (r - 1) * (k - 1) AS dof,
             CASE WHEN {str(correction).upper()} AND (r - 1) * (k - 1) = 1
                  THEN (SELECT sum(power(greatest(t.dev - 0.5, 0), 2) / (ri * cj / e.n)) FROM rx, cy, (SELECT max(n) AS n FROM n) e)
                  ELSE plain END AS chi2 FROM t),
v AS (SELECT *, greatest(0.0, chi2 / n - (k - 1.0) * (r - 1.0) / (n - 1)) AS phi2c,
             least(k - (k - 1.0) * (k - 1.0) / (n - 1) - 1, r - (r - 1.0) * (r - 1.0) / (n - 1) - 1) AS rk
      FROM c)
SELECT '{a}' AS x, '{b}' AS y, round(chi2, 6) + 0.0 AS chi2, CAST(dof AS BIGINT) AS dof,
       round(CASE WHEN rk = 0 THEN 1.0 ELSE sqrt(phi2c / rk) END, 6) + 0.0 AS cramers_v FROM v)"""


SIZED = "(SELECT *, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size_class FROM lineitem)"
ORACLE["q_cramers"] = (chi_sql(SIZED, "l_returnflag", "l_linestatus") + " UNION ALL "
                       + chi_sql(SIZED, "l_linestatus", "size_class"))


def binned(src: str, col: str) -> str:
    return f"""(SELECT * REPLACE (CAST(CAST(CASE WHEN {col} IS NULL THEN NULL WHEN mx = mn THEN 0
                 ELSE least(floor(({col} - mn) / ((mx - mn) / 10.0)), 9) END AS INTEGER) AS VARCHAR) AS {col})
        FROM {src}, (SELECT min({col}) AS mn, max({col}) AS mx FROM {src}))"""


def auto_sql() -> str:
    parts = [f"SELECT x, y, 'spearman' AS method, r AS value FROM ({spearman_sql('lineitem', 'l_quantity', 'l_discount')})"]
    num, cat = ["l_quantity", "l_discount"], ["l_returnflag", "l_linestatus"]
    allc = num + cat
    for i, a in enumerate(allc):
        for b in allc[i + 1:]:
            if a in num and b in num:
                continue
            src = "lineitem"
            if a in num:
                src = binned(src, a)
            if b in num:
                src = binned(src, b)
            parts.append(f"SELECT x, y, 'cramers' AS method, cramers_v AS value FROM {chi_sql(src, a, b)}")
    return " UNION ALL ".join(parts)


ORACLE["q_auto"] = auto_sql()

ALERT_COLS = NUM_COLS + ["l_linenumber", "tax_or_null"]
ALERT_SRC = "(SELECT *, nullif(l_tax, 0.0) AS tax_or_null FROM lineitem)"
ORACLE["q_alerts"] = f"""
WITH l AS ({long_sql(ALERT_SRC, ALERT_COLS)}),
p AS (SELECT feature, count(value) AS cnt, count(*) FILTER (WHERE value IS NULL) AS miss,
             count(DISTINCT value) AS dist, count(*) FILTER (WHERE value = 0) AS zeros,
             skewness(value) AS skew FROM l GROUP BY feature),
pr AS ({' UNION ALL '.join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM {ALERT_SRC}" for i, a in enumerate(ALERT_COLS) for b in ALERT_COLS[i + 1:])}),
hc AS (SELECT feature, max(abs(r)) AS v FROM (SELECT x AS feature, r FROM pr UNION ALL SELECT y, r FROM pr)
       WHERE abs(r) > 0.9 GROUP BY feature)
SELECT feature, 'constant' AS alert, CAST(dist AS DOUBLE) AS value FROM p WHERE dist = 1
UNION ALL SELECT feature, 'unique', CAST(dist AS DOUBLE) FROM p WHERE dist = cnt AND cnt > 0
UNION ALL SELECT feature, 'missing', round(miss / (cnt + miss), 6) + 0.0 FROM p WHERE miss / (cnt + miss) > 0.2
UNION ALL SELECT feature, 'zeros', round(zeros / cnt, 6) + 0.0 FROM p WHERE zeros / cnt > 0.1
UNION ALL SELECT feature, 'skewed', round(skew, 6) + 0.0 FROM p WHERE abs(skew) > 20
UNION ALL SELECT feature, 'high_correlation', round(v, 6) + 0.0 FROM hc
"""


def _stable(sql: str) -> str:
    """Rewrite each ``round(E, 6) + 0.0`` into the magnitude-aware rounding
    used on the Spark side (10 significant digits from 1e4 up)."""
    out, i = [], 0
    tail = ", 6) + 0.0"
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len("round")
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = sql[j + len("round("):k]
        if sql[k - 3:k + 7] == tail and inner.endswith(", 6"):
            e = f"(({_stable(inner[:-3])}) * 1.0000000000003)"
            out.append(sql[i:j])
            out.append(f"(CASE WHEN abs({e}) >= 1e4 THEN CAST(printf('%.9e', {e}) AS DOUBLE) "
                       f"ELSE round({e}, 6) END + 0.0)")
            i = k + 7
        else:
            out.append(sql[i:j + len("round(")])
            i = j + len("round(")


ORACLE = {k: _stable(v) for k, v in ORACLE.items()}

# --------------------------------------------------------------------------- select / model / explain
NUDGE = "1.0000000000003"

ORACLE["q_impute"] = _stable("""
WITH d AS (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS discount FROM lineitem)
SELECT l_orderkey, l_linenumber, round(coalesce(discount, avg(discount) OVER ()), 6) + 0.0 AS discount
FROM d
""")

MI_F = ["l_quantity", "l_discount", "l_tax"]


MI_EDGES = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"


def _bin_sql(c: str) -> str:
    return f"len(list_filter(e_{c}, lambda z: z < {c}))"


ORACLE["q_mi"] = _stable(f"""
WITH d AS (SELECT {', '.join(f'{c} + 0.0 AS {c}' for c in MI_F)}, l_extendedprice + 0.0 AS y
           FROM lineitem WHERE l_extendedprice IS NOT NULL),
r AS (SELECT {', '.join(f'quantile_cont({c}, {MI_EDGES}) AS e_{c}' for c in MI_F + ['y'])} FROM d),
b AS (SELECT {', '.join(f'{_bin_sql(c)} AS {c}' for c in MI_F + ['y'])} FROM d, r),
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS xb, y AS yb FROM b" for c in MI_F)}),
joint AS (SELECT feature, xb, yb, count(*) AS nxy FROM long GROUP BY feature, xb, yb),
px AS (SELECT feature, xb, sum(nxy) AS nx FROM joint GROUP BY feature, xb),
py AS (SELECT feature, yb, sum(nxy) AS ny FROM joint GROUP BY feature, yb),
n AS (SELECT feature, sum(nxy) AS n FROM joint GROUP BY feature)
SELECT j.feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) + 0.0 AS relevance
FROM joint j JOIN px USING (feature, xb) JOIN py USING (feature, yb) JOIN n USING (feature)
GROUP BY j.feature
""")

REGIONS = """(SELECT l.l_orderkey, l.l_linenumber, r.r_name AS region, l.l_quantity, l.l_extendedprice
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

FITS = f"""fits AS (SELECT region, regr_intercept(l_extendedprice, l_quantity) AS a,
                      regr_slope(l_extendedprice, l_quantity) AS b FROM {REGIONS} GROUP BY region),
pred AS (SELECT d.*, a + b * l_quantity AS prediction FROM {REGIONS} d JOIN fits USING (region))"""

ORACLE["q_ols_group"] = _stable(f"""
SELECT region, round(regr_intercept(l_extendedprice, l_quantity), 6) + 0.0 AS intercept,
       round(regr_slope(l_extendedprice, l_quantity), 6) + 0.0 AS l_quantity
FROM {REGIONS} GROUP BY region
""")

ORACLE["q_metrics"] = _stable(f"""
WITH {FITS}
SELECT region, round(avg(abs(l_extendedprice - prediction)), 6) + 0.0 AS mae,
       round(avg((l_extendedprice - prediction) ^ 2), 6) + 0.0 AS mse,
       round(sqrt(avg((l_extendedprice - prediction) ^ 2)), 6) + 0.0 AS rmse,
       round(1 - sum((l_extendedprice - prediction) ^ 2) / (var_pop(l_extendedprice) * count(*)), 6) + 0.0 AS r2,
       round(sqrt(avg((ln(1 + abs(prediction)) - ln(1 + abs(l_extendedprice))) ^ 2)), 6) + 0.0 AS rmsle,
       round(avg(abs(l_extendedprice - prediction) / nullif(abs(l_extendedprice), 0)), 6) + 0.0 AS mape
FROM pred GROUP BY region
""")

ORACLE["q_residuals"] = f"""
WITH {FITS}
SELECT l_orderkey, l_linenumber, region,
       round(l_extendedprice * {NUDGE}, 2) + 0.0 AS label,
       round(prediction * {NUDGE}, 2) + 0.0 AS prediction,
       round((l_extendedprice - prediction) * {NUDGE}, 2) + 0.0 AS residual
FROM pred
"""

ORACLE["q_linear_shap"] = f"""
WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b,
                  regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS m
           FROM lineitem)
SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature,
       round(l_quantity * {NUDGE}, 2) + 0.0 AS value,
       round(b * (l_quantity - m) * {NUDGE}, 2) + 0.0 AS shap,
       round((a + b * m) * {NUDGE}, 2) + 0.0 AS base
FROM lineitem, c
"""

ORACLE["q_cooks"] = f"""
WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx,
                  regr_sxx(l_extendedprice, l_quantity) AS sxx,
                  regr_slope(l_extendedprice, l_quantity) AS b,
                  regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, 1.0 / n + (l_quantity - mx) ^ 2 / sxx AS h,
             l_extendedprice - (a + b * l_quantity) AS e FROM lineitem, s),
m AS (SELECT sum(e * e) / (max(s.n) - 2) AS s2 FROM r, s)
SELECT l_orderkey, l_linenumber,
       CAST(printf('%.5e', h * {NUDGE}) AS DOUBLE) AS leverage,
       round(e * {NUDGE}, 2) + 0.0 AS residual,
       CAST(printf('%.5e', e * e / (2 * s2) * h / ((1 - h) ^ 2) * {NUDGE}) AS DOUBLE) AS cooks
FROM r, m
"""

ORACLE["q_season_windows"] = _stable("""
SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year,
       round(coalesce(sum(CASE WHEN month(l_shipdate) BETWEEN 3 AND 5 THEN l_extendedprice END), 0.0), 6) + 0.0 AS spring,
       round(coalesce(sum(CASE WHEN month(l_shipdate) BETWEEN 6 AND 8 THEN l_extendedprice END), 0.0), 6) + 0.0 AS summer,
       round(coalesce(sum(CASE WHEN month(l_shipdate) BETWEEN 5 AND 9 THEN l_extendedprice END), 0.0), 6) + 0.0 AS growing,
       round(coalesce(sum(CASE WHEN month(l_shipdate) BETWEEN 1 AND 2 THEN l_extendedprice END), 0.0), 6) + 0.0 AS winter_start
FROM lineitem GROUP BY l_suppkey, year(l_shipdate)
""")

ORACLE["q_error_line"] = _stable(f"""
WITH {FITS}
SELECT region, round(regr_slope(prediction, l_extendedprice), 6) + 0.0 AS slope,
       round(regr_intercept(prediction, l_extendedprice), 6) + 0.0 AS intercept,
       round(regr_r2(prediction, l_extendedprice), 6) + 0.0 AS r2
FROM pred GROUP BY region
""")


def _mrmr_sql() -> str:
    f = MI_F
    idx = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS idx" for i, c in enumerate(f))
    pairs = [(a, b) for i, a in enumerate(f) for b in f[i + 1:]]
    pair_rows = " UNION ALL ".join(
        f"SELECT '{a}' AS fa, '{b}' AS fb, {a} AS xa, {b} AS xb FROM b" for a, b in pairs)
    return f"""
WITH d AS (SELECT {', '.join(f'{c} + 0.0 AS {c}' for c in f)}, l_extendedprice + 0.0 AS y
           FROM lineitem WHERE l_extendedprice IS NOT NULL),
r AS (SELECT {', '.join(f'quantile_cont({c}, {MI_EDGES}) AS e_{c}' for c in f + ['y'])} FROM d),
b AS (SELECT {', '.join(f'{_bin_sql(c)} AS {c}' for c in f + ['y'])} FROM d, r),
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS xb, y AS yb FROM b" for c in f)}),
joint AS (SELECT feature, xb, yb, count(*) AS nxy FROM long GROUP BY feature, xb, yb),
px AS (SELECT feature, xb, sum(nxy) AS nx FROM joint GROUP BY feature, xb),
py AS (SELECT feature, yb, sum(nxy) AS ny FROM joint GROUP BY feature, yb),
n AS (SELECT feature, sum(nxy) AS n FROM joint GROUP BY feature),
rel AS (SELECT j.feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS relevance
        FROM joint j JOIN px USING (feature, xb) JOIN py USING (feature, yb) JOIN n USING (feature)
        GROUP BY j.feature),
ix AS ({idx}),
pr AS ({pair_rows}),
pj AS (SELECT fa, fb, xa, xb, count(*) AS nxy FROM pr GROUP BY fa, fb, xa, xb),
pa AS (SELECT fa, fb, xa, sum(nxy) AS na FROM pj GROUP BY fa, fb, xa),
pb AS (SELECT fa, fb, xb, sum(nxy) AS nb FROM pj GROUP BY fa, fb, xb),
pn AS (SELECT fa, fb, sum(nxy) AS n FROM pj GROUP BY fa, fb),
red AS (SELECT fa, fb, sum(nxy / n * ln(nxy * n / (na * nb))) AS mi
        FROM pj JOIN pa USING (fa, fb, xa) JOIN pb USING (fa, fb, xb) JOIN pn USING (fa, fb)
        GROUP BY fa, fb),
red2 AS (SELECT fa AS f1, fb AS f2, mi FROM red UNION ALL SELECT fb, fa, mi FROM red),
s1 AS (SELECT rel.feature, rel.relevance, 0.0 AS redundancy, rel.relevance AS score
       FROM rel JOIN ix ON ix.feature = rel.feature ORDER BY rel.relevance DESC, ix.idx LIMIT 1),
c2 AS (SELECT rel.feature, rel.relevance, red2.mi AS redundancy, rel.relevance - red2.mi AS score,
              ix.idx
       FROM rel JOIN ix ON ix.feature = rel.feature JOIN red2 ON red2.f1 = rel.feature
       JOIN s1 ON red2.f2 = s1.feature),
s2 AS (SELECT feature, relevance, redundancy, score FROM c2 ORDER BY score DESC, idx LIMIT 1),
c3 AS (SELECT rel.feature, rel.relevance, (ra.mi + rb.mi) / 2 AS redundancy,
              rel.relevance - (ra.mi + rb.mi) / 2 AS score
       FROM rel JOIN red2 ra ON ra.f1 = rel.feature JOIN s1 ON ra.f2 = s1.feature
       JOIN red2 rb ON rb.f1 = rel.feature JOIN s2 ON rb.f2 = s2.feature
       WHERE rel.feature NOT IN (SELECT feature FROM s1) AND rel.feature NOT IN (SELECT feature FROM s2))
SELECT 1 AS rank, feature, round(relevance, 6) + 0.0 AS relevance, round(redundancy, 6) + 0.0 AS redundancy,
       round(score, 6) + 0.0 AS score FROM s1
UNION ALL SELECT 2, feature, round(relevance, 6) + 0.0, round(redundancy, 6) + 0.0, round(score, 6) + 0.0 FROM s2
UNION ALL SELECT 3, feature, round(relevance, 6) + 0.0, round(redundancy, 6) + 0.0, round(score, 6) + 0.0 FROM c3
"""


ORACLE["q_mrmr"] = _stable(_mrmr_sql())

_BUCKET = "CAST('0x' || substr(md5(concat_ws('|', state, county, year, crop, '{seed}')), 1, 8) AS UBIGINT) % 100"
_LINE_FRAME = f"""{WITH_ALL},
f AS (SELECT y.state, y.county, y.year, y.crop, y.value AS yield, w.gdd {FRAME_FROM} WHERE {NOT_SENTINEL}),
rows AS (SELECT yield AS y, gdd, {_BUCKET.format(seed=42)} AS b, {_BUCKET.format(seed=44)} AS c FROM f)"""


def _line_r2(fits: str, name: str, key: str) -> str:
    """R2 on training part and test split of the lines in ``fits`` (key, cut, fill, slope, icpt)."""
    return f"""
res AS (SELECT {key}, b < 70 AS train, y, y - icpt - slope * coalesce(gdd, fill) AS e
        FROM rows, fits WHERE b >= 70 OR c < cut),
r AS (SELECT {key}, train, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM res GROUP BY {key}, train)
SELECT {key} AS {name}, round(max(CASE WHEN train THEN r2 END), 6) + 0.0 AS train_r2,
       round(max(CASE WHEN NOT train THEN r2 END), 6) + 0.0 AS test_r2
FROM r GROUP BY {key}"""


ORACLE["q_learning_gdd"] = f"""{_LINE_FRAME},
shares AS (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS share, unnest([20, 40, 60, 80, 100]) AS cut),
means AS (SELECT share, cut, avg(gdd) AS fill FROM rows, shares WHERE b < 70 AND c < cut GROUP BY share, cut),
fits AS (SELECT share, cut, fill, regr_slope(y, coalesce(gdd, fill)) AS slope,
                regr_intercept(y, coalesce(gdd, fill)) AS icpt
         FROM rows, means WHERE b < 70 AND c < cut GROUP BY share, cut, fill),
{_line_r2('fits', 'share', 'share')}"""

ORACLE["q_vc_ridge"] = f"""{_LINE_FRAME},
grid AS (SELECT unnest(['0.0', '1000.0', '10000.0', '100000.0']) AS value, unnest([0.0, 1e3, 1e4, 1e5]::DOUBLE[]) AS penalty),
means AS (SELECT avg(gdd) AS fill FROM rows WHERE b < 70),
line AS (SELECT fill, regr_slope(y, coalesce(gdd, fill)) AS s, avg(coalesce(gdd, fill)) AS mx, avg(y) AS my,
                stddev_pop(y) AS sy FROM rows, means WHERE b < 70 GROUP BY fill),
fits AS (SELECT value, 100 AS cut, fill, s / (1 + penalty / sy) AS slope, my - s / (1 + penalty / sy) * mx AS icpt
         FROM line, grid),
{_line_r2('fits', 'value', 'value')}"""

ORACLE["q_shap_linear"] = f"""{WITH_ALL},
f AS (SELECT y.state, y.county, y.year, y.crop, y.value AS yield, w.gdd {FRAME_FROM}
      WHERE {NOT_SENTINEL}),
s AS (SELECT regr_slope(yield, gdd) AS b, avg(gdd) AS m, avg(yield) AS ybar FROM f)
SELECT state, county, year, crop, 'gdd' AS feature,
       round(b * (gdd - m) * {NUDGE}, 2) + 0.0 AS shap, round(ybar * {NUDGE}, 2) + 0.0 AS base
FROM f, s
"""


RANKED = """(SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS l_quantity, l_extendedprice,
                    nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.02) AS l_tax FROM lineitem)"""
RANKED_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLE["q_spearman_null"] = " UNION ALL ".join(
    spearman_sql(RANKED, a, b) for i, a in enumerate(RANKED_COLS) for b in RANKED_COLS[i + 1:])

NAN_COLS = ["l_quantity", "l_discount", "l_extendedprice"]
NAN_PAIRS = [(a, b) for i, a in enumerate(NAN_COLS) for b in NAN_COLS[i + 1:]]
ORACLE["q_profile_nan"] = " UNION ALL ".join(
    [f"SELECT 'pearson' AS kind, '{a}' AS x, '{b}' AS y, {r6(f'corr({a}, {b})', 'value')} FROM {RANKED}" for a, b in NAN_PAIRS]
    + [f"SELECT 'spearman' AS kind, x, y, r AS value FROM ({spearman_sql(RANKED, a, b)})" for a, b in NAN_PAIRS]
    + [f"SELECT 'missing' AS kind, '{a}' AS x, '{b}' AS y, round(CASE WHEN count({a}) = count(*) OR count({b}) = count(*) "
       f"THEN NULL ELSE corr(CAST({a} IS NULL AS DOUBLE), CAST({b} IS NULL AS DOUBLE)) END, 6) + 0.0 AS value FROM {RANKED}"
       for a, b in NAN_PAIRS]
    + [f"SELECT 'missing' AS kind, '{a}' AS x, '{a}' AS y, CAST(count(*) - count({a}) AS DOUBLE) AS value FROM {RANKED}"
       for a in NAN_COLS])


FLAGGED = """(SELECT l_linestatus, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size_class,
                     year(l_shipdate) >= 1996 AS late, l_extendedprice > 30000 AS dear FROM lineitem)"""


def phik_sql(a: str, b: str) -> str:
    """Two by two: a quadrant of the bivariate normal holds 1/4 + asin(rho) / (2 pi)."""
    return f"""(WITH c AS (SELECT {a} AS u, {b} AS v, CAST(count(*) AS DOUBLE) AS o FROM {FLAGGED}
  WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
m AS (SELECT u, v, o, sum(o) OVER (PARTITION BY u) AS r, sum(o) OVER (PARTITION BY v) AS k, sum(o) OVER () AS n FROM c),
t AS (SELECT max(n) AS n, max(n) * sum(o * o / (r * k)) - max(n) AS chi2,
             count(DISTINCT u) AS nu, count(DISTINCT v) AS nv FROM m)
SELECT '{a}' AS x, '{b}' AS y, round(CASE WHEN nu < 2 OR nv < 2 THEN NULL WHEN chi2 <= 1 THEN 0.0
  ELSE sin(pi() / 2 * sqrt(least(1.0, (chi2 - 1) / (n - 1)))) END, 6) + 0.0 AS phik FROM t)"""


FLAG_COLS = ["l_linestatus", "size_class", "late", "dear"]
ORACLE["q_phik"] = " UNION ALL ".join(
    f"SELECT * FROM {phik_sql(a, b)}" for i, a in enumerate(FLAG_COLS) for b in FLAG_COLS[i + 1:])

ORACLE["q_shap_product"] = """
WITH d AS (SELECT l_orderkey, sum(l_quantity) AS q, max(l_discount) AS d, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
b AS (SELECT round(avg(q), 1) AS q, round(avg(d), 3) AS d FROM d GROUP BY lines),
m AS (SELECT avg(q) AS mq, avg(d) AS md, avg(q * d) AS mqd FROM b),
v AS (SELECT l_orderkey, q * d AS whole, q * md AS qonly, mq * d AS donly, mqd AS none FROM d, m),
s AS (SELECT l_orderkey, 'quantity' AS feature, ((qonly - none) + (whole - donly)) / 2 AS shap, none, whole FROM v
      UNION ALL SELECT l_orderkey, 'discount', ((donly - none) + (whole - qonly)) / 2, none, whole FROM v)
SELECT l_orderkey, feature, round(shap * 1.0000000000003, 6) + 0.0 AS shap, round(none * 1.0000000000003, 6) + 0.0 AS base,
       round(whole * 1.0000000000003, 6) + 0.0 AS prediction FROM s
"""


def knn_sql(f: str) -> str:
    """The nearest-neighbour estimate by comparing all pairs of customers."""
    return f"""(WITH d AS (SELECT o_custkey, count(*) AS orders, max(o_totalprice) AS dearest, round(sum(o_totalprice), 2) AS spent,
                  any_value(c_acctbal) AS c_acctbal
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey),
e AS (SELECT min({f}) AS mx, CAST(format('{{:.9e}}', stddev_pop({f})) AS DOUBLE) AS sx,
             min(spent) AS my, CAST(format('{{:.9e}}', stddev_pop(spent)) AS DOUBLE) AS sy FROM d),
z AS (SELECT o_custkey AS i, CAST(floor(({f} - mx) / sx * 1073741824.0) AS BIGINT) AS x,
             CAST(floor((spent - my) / sy * 1073741824.0) AS BIGINT) AS y FROM d, e),
k AS (SELECT a.i, any_value(a.x) AS x, any_value(a.y) AS y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)[3] AS r
      FROM z a JOIN z b ON a.i <> b.i GROUP BY a.i),
c AS (SELECT k.i, count(*) FILTER (WHERE abs(k.x - b.x) < greatest(r, 1)) AS nx,
             count(*) FILTER (WHERE abs(k.y - b.y) < greatest(r, 1)) AS ny FROM k, z b GROUP BY k.i),
h AS (SELECT n, -0.57721566490153286 + coalesce(sum(1.0 / (n - 1)) FILTER (WHERE n > 1) OVER (ORDER BY n), 0) AS psi
      FROM range(1, (SELECT count(*) + 2 FROM z)) t(n))
SELECT '{f}' AS feature, round(greatest(0.0, (SELECT psi FROM h WHERE n = (SELECT count(*) FROM z))
  + (SELECT psi FROM h WHERE n = 3) - avg(p.psi + q.psi)), 6) + 0.0 AS relevance
FROM c JOIN h p ON p.n = c.nx JOIN h q ON q.n = c.ny)"""


ORACLE["q_mi_knn"] = " UNION ALL ".join(f"SELECT * FROM {knn_sql(f)}" for f in ("orders", "dearest", "c_acctbal"))


def regional_trees_sql(depth: int, bins: int = 8) -> str:
    """Trees of all regions, level by level."""
    cols = ["l_quantity", "l_discount", "l_tax"]
    probs = "[" + ", ".join(str(i / bins) for i in range(1, bins)) + "]"
    parts = [f"""d AS (SELECT r_name AS region, l_quantity, l_discount, l_tax, l_extendedprice AS y
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)""",
             "e AS (SELECT " + ", ".join(f"quantile_cont({c}, {probs}) AS e{i}" for i, c in enumerate(cols)) + " FROM d)",
             "rows0 AS (SELECT region, y, 1 AS node, " + ", ".join(
                 f"len(list_filter(e{i}, lambda t: {c} > t)) AS b{i}" for i, c in enumerate(cols)) + " FROM d, e)"]
    out = []
    for k in range(depth):
        parts.append(f"""cells{k} AS (SELECT region, node, col, bin, count(*) AS n, sum(y) AS s
  FROM (SELECT region, node, y, unnest([0, 1, 2]) AS col, unnest([b0, b1, b2]) AS bin FROM rows{k}) GROUP BY ALL)""")
        parts.append(f"""side{k} AS (SELECT region, node, col, bin, sum(n) OVER w AS ln, sum(s) OVER w AS ls,
  sum(n) OVER (PARTITION BY region, node, col) AS n, sum(s) OVER (PARTITION BY region, node, col) AS s
  FROM cells{k} WINDOW w AS (PARTITION BY region, node, col ORDER BY bin ROWS UNBOUNDED PRECEDING))""")
        parts.append(f"""best{k} AS (SELECT *, ln * (n - ln) / n * power(ls / ln - (s - ls) / (n - ln), 2) AS gain
  FROM side{k} WHERE n > ln QUALIFY row_number() OVER (PARTITION BY region, node ORDER BY gain DESC, col, bin) = 1)""")
        parts.append(f"""nodes{k} AS (SELECT t.region, t.node, t.n, t.p, col, bin, gain FROM
  (SELECT region, node, count(*) AS n, avg(y) AS p FROM rows{k} GROUP BY region, node) t
  LEFT JOIN (SELECT * FROM best{k} WHERE gain > 1e-12) b ON b.region = t.region AND b.node = t.node)""")
        parts.append(f"""rows{k + 1} AS (SELECT r.region, y, 2 * r.node + CAST(CASE b.col WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END
  > b.bin AS INTEGER) AS node, b0, b1, b2 FROM rows{k} r JOIN nodes{k} b ON b.region = r.region AND b.node = r.node
  WHERE b.col IS NOT NULL)""")
        out.append(f"SELECT region, node, n, p, col, bin, gain FROM nodes{k}")
    out.append(f"SELECT region, node, count(*), avg(y), NULL, NULL, NULL FROM rows{depth} GROUP BY region, node")
    return f"""WITH {', '.join(parts)}, every AS ({' UNION ALL '.join(out)})
SELECT region, CAST(node AS INTEGER) AS node, CAST(n AS BIGINT) AS n, {r6('p', 'prediction')},
       CASE col WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'l_discount' WHEN 2 THEN 'l_tax' END AS feature,
       {r6('CASE col WHEN 0 THEN e0[bin + 1] WHEN 1 THEN e1[bin + 1] WHEN 2 THEN e2[bin + 1] END', 'threshold')},
       {r6('gain')}
FROM every, e"""


ORACLE["q_regional_trees"] = regional_trees_sql(2)

ORACLE["q_sketch_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, count(*) - count({c}) AS missing, {r6(f'min({c})', 'min')}, "
    f"{r6(f'max({c})', 'max')}, {r6(f'avg({c})', 'mean')}, TRUE AS distinct_near, TRUE AS p50_near, TRUE AS p95_near FROM lineitem"
    for c in NUM_COLS)

for _name in ("q_sketch_profile", "q_spearman_null", "q_profile_nan", "q_phik", "q_mi_knn", "q_regional_trees"):
    ORACLE[_name] = _stable(ORACLE[_name])

ORACLE["q_upsert_bucketed"] = ORACLE["q_upsert_merge"]     # the same rows by another plan

# --------------------------------------------------------------------------- landed files
ORACLE["q_yield_csv"] = _stable(f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, 'S' || (o_custkey % 3) AS state, 'C' || o_custkey AS county,
       o_orderpriority AS crop, {r6('o_totalprice', 'value')}, lower(o_orderpriority) || ' - Yield, measured in BU / ACRE' AS unit,
       'D' || (o_custkey % 10) AS district,
       CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey % 100 AS VARCHAR) END AS county_ansi
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND (o_orderkey % 3 <> 0 OR o_totalprice < 999.995)
  AND year(o_orderdate) BETWEEN 1993 AND 1997
""")

DAILY = """lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name, year(l_shipdate)"""
ORACLE["q_daily_grid"] = _stable(f"""
SELECT n.n_name AS county, r.r_name AS state, CAST(year(l_shipdate) AS INTEGER) AS year,
       {r6(f'coalesce(sum(CASE WHEN {SEASON} THEN l_extendedprice END), 0.0)', 'precipitation')},
       {r6(f'avg(CASE WHEN {SEASON} THEN (l_quantity + l_tax) / 2 END)', 'avg_temp')},
       {r6(f'coalesce(sum(CASE WHEN {SEASON} THEN greatest((l_quantity + l_tax) / 2 - 10.0, 0.0) END), 0.0)', 'gdd')},
       {r6(f'avg(CASE WHEN {SEASON} AND l_linenumber <> 2 THEN l_discount END)', 'vp')},
       {r6(f'avg(CASE WHEN {SEASON} THEN l_tax END)', 'srad')}
FROM {DAILY}""")

ORACLE["q_daily_csv"] = _stable(f"""
SELECT n.n_name AS county, r.r_name AS state, CAST(year(l_shipdate) AS INTEGER) AS year,
       {r6(f'coalesce(sum(CASE WHEN {SEASON} THEN l_extendedprice END), 0.0)', 'precipitation')},
       {r6(f'avg(CASE WHEN {SEASON} THEN l_quantity / 2 END)', 'avg_temp')},
       {r6(f'coalesce(sum(CASE WHEN {SEASON} THEN greatest((l_quantity + l_tax) / 2 - 10.0, 0.0) END), 0.0)', 'gdd')}
FROM {DAILY}""")

ORACLE["q_soil_tables"] = _stable(f"""
WITH u AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS acres FROM lineitem GROUP BY l_suppkey, l_partkey),
h AS (SELECT r_name AS state, n_name AS county, p_size / 100.0 * acres AS w, p_size % 14 AS ph, p_size % 20 AS cec,
             p_partkey % 60 AS sand, p_partkey % 30 AS clay, p_size % 5 AS om
      FROM u JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 7 <> 0)
SELECT state, county, {r6('sum(ph * w) / sum(w)', 'ph')}, {r6('sum(cec * w) / sum(w)', 'cec')},
       {r6('sum(sand * w) / sum(w)', 'sand_pct')}, {r6('sum(clay * w) / sum(w)', 'clay_pct')},
       {r6('sum(om * w) / sum(w)', 'organic_matter')} FROM h GROUP BY state, county
""")

ORACLE["q_response_table"] = """
SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS line, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity,
       CAST(NULL AS VARCHAR) AS unit FROM lineitem"""

ORACLE["q_stream_upsert"] = _stable(f"""WITH {YIELDS_CTE}
SELECT year, state, district, county, county_ansi, crop,
       {r6('round(value, 1) * CASE WHEN year % 2 = 0 THEN 2 ELSE 1 END', 'value')}, 'YIELD' AS unit FROM yields""")

ORACLE["q_explanations"] = f"SELECT *, 'lr' AS model, '2024-01-01T00:00' AS run_ts FROM ({ORACLE['q_linear_shap']})"

ORACLE["q_saved_model"] = f"""{WITH_ALL},
f AS (SELECT y.state, y.county, y.year, y.crop, y.value AS yield, w.gdd {FRAME_FROM} WHERE {NOT_SENTINEL}),
m AS (SELECT avg(gdd) AS fill FROM f),
s AS (SELECT regr_slope(yield, coalesce(gdd, fill)) AS b, regr_intercept(yield, coalesce(gdd, fill)) AS a FROM f, m)
SELECT state, county, year, crop, round((a + b * coalesce(gdd, fill)) * {NUDGE}, 2) + 0.0 AS prediction FROM f, m, s
"""
