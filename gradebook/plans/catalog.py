"""Query registry.

``register(name, views=..., sql=..., doubles=...)`` decorates a ``(spark, sf_dir) -> DataFrame``
builder.  ``sql`` is DuckDB text over the driver tables; ``views`` names the fixture CTEs it
needs; ``doubles`` lists the DOUBLE output columns.  Operators return doubles as they are; only the
registered queries, which are what is checked, give them in ``DIGITS`` significant digits on both sides, so that
floating noise (summation order) does not break the value hash and small p-values stay what they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import with_views

DIGITS = 9   # significant digits in which registered results are compared


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    views: tuple[str, ...] = ()
    doubles: tuple[str, ...] = ()
    tags: tuple[str, ...] = field(default_factory=tuple)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return significant(self.build(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip().rstrip(";")
        if self.doubles:
            rep = ", ".join(f"CAST(format('{{:.{DIGITS - 1}e}}', CAST({c} AS DOUBLE) + 0.0) AS DOUBLE) AS {c}" for c in self.doubles)
            body = f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS _oracle"
        return with_views(body, *self.views)


REGISTRY: dict[str, Query] = {}


def register(name: str, *, sql: str | None = None, views: tuple[str, ...] | list[str] = (),
             doubles: tuple[str, ...] | list[str] = (), tags: tuple[str, ...] = ()):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(views), tuple(doubles), tuple(tags))
        return fn
    return deco


def significant(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``df`` with doubles in so many significant digits."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # a number of so many digits, six of them decimals, is what it should be: found by arithmetic, as making the text takes ten times as long
            x = c + F.lit(0.0)
            whole = F.rint(x * F.lit(1e6))
            short = (F.abs(whole) < F.lit(10.0 ** digits)) & (whole / F.lit(1e6) == x)
            c = F.when(c.isNotNull(), F.when(short, x).otherwise(F.format_string(f"%.{digits - 1}e", x).cast("double")))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_all() -> dict[str, Query]:
    """Import every query module (registration happens at import)."""
    from . import (  # noqa: F401
        q_grading, q_summary, q_agreement, q_inference, q_resample, q_judging, q_corpus, q_prompts, q_reshape, q_landing,
        q_sources,
    )
    return REGISTRY
