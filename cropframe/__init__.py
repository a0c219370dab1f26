"""cropframe: regional crop-yield analytics as Spark DataFrame operators.

Every operator takes DataFrames plus column *roles* (key columns, date,
measures, ...) and returns a DataFrame, so the same code runs on the crop
tables and on any other keyed, dated table.
"""

from cropframe.session import checkpoint_dir, get_spark, job_session, ship

__all__ = ["get_spark", "job_session", "checkpoint_dir", "ship"]
