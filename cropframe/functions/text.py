"""Text scalar functions: key normalisation, area names, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The catalog spells an area as '<county> County, <state>'.
COUNTY_SUFFIX = " County,"
AREA_TEMPLATE_SEP = " County, "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c) -> Column:
    """upper(trim(x)): the form in which group keys and parameters compare."""
    return F.upper(F.trim(_c(c)))


def county_name(areaname) -> Column:
    """Text before ' County,' or the whole name when it is absent."""
    return F.substring_index(_c(areaname), COUNTY_SUFFIX, 1)


def area_name(county, state) -> Column:
    """'<county> County, <state>' (F11, J8)."""
    return F.concat(_c(county), F.lit(AREA_TEMPLATE_SEP), _c(state))


def plain_code(c) -> Column:
    """Nullable code as plain text: '37' stays '37', NULL stays NULL (C4, Q7)."""
    c = _c(c)
    s = c.cast(T.StringType())
    return F.when(c.isNull(), F.lit(None).cast(T.StringType())).otherwise(
        F.regexp_replace(s, r"\.0$", ""))


def first_truthy(*cols) -> Column:
    """First value that is neither NULL nor empty text (C12, `a or b`)."""
    parts = []
    for c in cols:
        c = _c(c)
        parts.append(F.when(c.cast(T.StringType()) != F.lit(""), c))
    return F.coalesce(*parts)
