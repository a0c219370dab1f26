"""Sources and sinks (S1-S8, D7; sinks live in operators.upsert and operators.explain)."""

from cropframe.sources.files import (concat_frames, decode_response_table, read_catalog,
                                     read_daily_csv, read_daily_grid, read_soil_tables,
                                     read_yield_csv, read_yield_json)
from cropframe.sources.tables import driver_table, read_table, read_table_jdbc

__all__ = [
    "read_yield_csv", "read_yield_json", "read_daily_grid", "read_daily_csv",
    "read_soil_tables", "decode_response_table", "read_catalog", "concat_frames",
    "read_table", "read_table_jdbc", "driver_table",
]
