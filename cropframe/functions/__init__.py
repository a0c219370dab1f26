"""Column-level helpers (scalar functions C1-C12): all built-in expressions."""

from cropframe.functions.dates import day_of_year_date, in_months, to_day
from cropframe.functions.numeric import (degree_days, midpoint, nan_to_null, parse_number,
                                         round_doubles, safe_div)
from cropframe.functions.text import area_name, county_name, first_truthy, norm_key, plain_code

__all__ = [
    "parse_number", "nan_to_null", "midpoint", "degree_days", "safe_div", "round_doubles",
    "county_name", "area_name", "norm_key", "first_truthy", "plain_code",
    "day_of_year_date", "to_day", "in_months",
]
