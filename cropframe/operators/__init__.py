"""DataFrame operators: season, soil, gaps, upsert, query, frame, profile,
select, model, explain. Each takes DataFrames plus column roles."""
