"""Named query catalog: each entry is a Spark plan plus an equivalent DuckDB oracle."""
