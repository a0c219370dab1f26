"""Numeric scalar functions: lenient parsing, NaN handling, agronomic formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what a lenient numeric parse accepts (decimal or exponent form,
# optional sign, surrounding blanks), matching a coercing text-to-number parse.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL, so sums and means skip it the way a pandas frame does."""
    c = _c(c)
    return F.nanvl(c, F.lit(None).cast(T.DoubleType()))


def parse_number(c, strip_thousands: bool = False) -> Column:
    """Text -> double; anything that is not a plain number becomes NULL.

    ``strip_thousands`` removes ',' first (the records path); without it
    '1,234' is not a number (the CSV path). Suffixes such as '45d' that a
    plain cast would accept are rejected by the pattern, and 'nan' is NULL.
    """
    s = _c(c).cast(T.StringType())
    if strip_thousands:
        s = F.regexp_replace(s, ",", "")
    ok = s.rlike(NUMBER_PATTERN)
    return F.when(ok, F.trim(s).try_cast(T.DoubleType()))


def midpoint(a, b) -> Column:
    """(a + b) / 2, NULL when either side is NULL."""
    return (_c(a) + _c(b)) / F.lit(2.0)


def degree_days(t, base: float = 10.0) -> Column:
    """max(t - base, 0) with NULL kept NULL (C9); bare greatest() would give 0."""
    t = _c(t)
    return F.when(t.isNotNull(), F.greatest(t - F.lit(float(base)), F.lit(0.0)))


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (pandas gives NaN -> NULL)."""
    return F.try_divide(_c(num), _c(den))


# Comparison rounding. Below BIG, `digits` decimals; from BIG
# up, 10 significant digits (6 decimals of a 1e9 sum are below double
# resolution, so summation order would show). Values are first scaled by
# NUDGE so an exact decimal tie (a mean such as 0.0399315) rounds the same
# way in every engine, whatever its last-bit summation noise.
BIG = 1e4
NUDGE = "1.0000000000003"


def stable_round(c, digits: int = 6) -> Column:
    """Round for order-insensitive comparison; -0.0 becomes 0.0."""
    x = _c(c).cast(T.DoubleType()) * F.lit(float(NUDGE))
    sig = F.format_string("%.9e", x).cast(T.DoubleType())
    return F.when(F.abs(x) >= F.lit(BIG), sig).otherwise(F.round(x, digits)) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Apply ``stable_round`` to every double column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(stable_round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
