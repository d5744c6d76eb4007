"""SQL twins of the named queries, for an independent check in DuckDB."""
