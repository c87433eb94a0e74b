"""Reshape operators: wide/long conversions with explicit value lists (no extra distinct job)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns that are NULL in every row.

    Each look asks for one row that has a value in a column without any so far, and ends as soon as there is one; a column is
    dropped only when a whole scan found none."""
    open_ = [c for c in df.columns if c not in keep]
    while open_:
        some = reduce(or_, [F.col(f"`{c}`").isNotNull() for c in open_])
        row = df.where(some).select(*[F.col(f"`{c}`").isNotNull().alias(f"_{i}") for i, c in enumerate(open_)]).first()
        if row is None:
            break
        open_ = [c for c, found in zip(open_, row) if not found]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in open_])


def wide_by(df: DataFrame, index: Sequence[str], column: str, values: Sequence, value: str,
            name=lambda v: str(v), order: str | None = None) -> DataFrame:
    """Pivot with a known value list, one output column per value.  A cell given more than once takes its value in the least row of
    ``order`` (say, the source file's name), or its least value: the same one whatever the order of rows."""
    cell = lambda v: F.when((F.col(column) == F.lit(v)) & F.col(value).isNotNull(), F.col(value) if order is None else F.struct(order, value))
    aggs = [(F.min(cell(v)) if order is None else F.min(cell(v))[value]).alias(name(v)) for v in values]
    return df.groupBy(*index).agg(*aggs)


def long_from(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    """Melt: ``df.unpivot`` (Expand node, one narrow stage)."""
    return df.unpivot(list(ids), list(values), var, val)


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
