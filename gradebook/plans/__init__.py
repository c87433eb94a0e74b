"""Named query catalogue: each entry builds a DataFrame from the driver tables and carries the
equivalent DuckDB SQL used as the correctness oracle."""
