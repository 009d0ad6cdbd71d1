"""Column expressions: no Python UDF, no global state, so they also run on streams."""
