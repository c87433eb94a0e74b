"""Column-level helpers (SQL-text kernels shared by Spark and the DuckDB oracle)."""
