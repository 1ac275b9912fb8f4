"""The query catalogue: every operator applied to tables, with its DuckDB oracle."""
