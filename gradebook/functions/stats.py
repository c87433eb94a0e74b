"""Closed-form statistics as SQL expression text.

Spark has no erf/erfc/lgamma, and the DuckDB oracle must compute the same numbers, so each
kernel is rendered as plain ANSI arithmetic (``exp``, ``sqrt``, ``power``, ``CASE``) that runs
unchanged in both engines.  Spark uses them through ``F.expr``; they run on result rows (a
handful per group), never on the raw fact table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % normal quantile used by the Wilson interval.
Z_975 = 1.959963984540054

_SERIES_TERMS = 60      # erf Maclaurin-type series (all terms positive) for x < 3
_CF_DEPTH = 60          # Laplace continued fraction for erfc, x >= 3


def lit(v: float) -> str:
    """Double literal that both engines parse as DOUBLE."""
    return "%.17E" % v


def wilson_sql(k: str, n: str, z: float = Z_975) -> tuple[str, str]:
    z2 = lit(z * z)
    zz = lit(z)
    p = f"(({k}) / ({n}))"
    den = f"(1 + {z2} / ({n}))"
    centre = f"(({p} + {z2} / (2 * ({n}))) / {den})"
    half = f"({zz} * sqrt({p} * (1 - {p}) / ({n}) + {z2} / (4 * ({n}) * ({n}))) / {den})"
    lo = f"CASE WHEN ({n}) > 0 THEN {centre} - {half} END"
    hi = f"CASE WHEN ({n}) > 0 THEN {centre} + {half} END"
    return lo, hi


def erfc_sql(x: str) -> str:
    """erfc(x) for x >= 0 (callers pass an absolute value)."""
    y = f"(2 * ({x}) * ({x}))"
    inner = "1"
    for n in range(_SERIES_TERMS, 0, -1):
        inner = f"(1 + {y} / {2 * n + 1} * {inner})"
    series = f"(1 - {lit(2 / math.sqrt(math.pi))} * exp(-({x}) * ({x})) * ({x}) * {inner})"
    t = f"({x})"
    for k in range(_CF_DEPTH, 0, -1):
        t = f"(({x}) + {lit(k / 2)} / {t})"
    cf = f"(exp(-({x}) * ({x})) / {lit(math.sqrt(math.pi))} / {t})"
    return f"(CASE WHEN ({x}) < 3 THEN {series} ELSE {cf} END)"


def normal_two_sided_p_sql(z: str) -> str:
    return f"least(1.0E0, {erfc_sql(f'abs({z}) / {lit(math.sqrt(2.0))}')})"


def chi2_sf_sql(x: str, df: str, dialect: str = "duckdb") -> str:
    """Upper tail of chi-square with any whole df >= 1: a finite sum over the actual df (even: Poisson terms; odd: erfc and
    half-integer terms).  Spark builds each term from the one before, DuckDB each from lgamma, so that the two sides check each other."""
    h = f"(({x}) / 2)"
    if dialect == "spark":
        def total(first: str, n: str, step: str) -> str:
            return (f"aggregate(sequence(0, CAST({n} AS INT)), named_struct('l', {first}, 's', 0.0D), (a, i) -> named_struct("
                    f"'l', a.l + ln({h}) - ln({step}), 's', a.s + exp(a.l)), a -> a.s)")
        even = total(f"-{h}", f"({df}) / 2 - 1", "i + 1")
        odd = f"({erfc_sql(f'sqrt({h})')} + IF(({df}) < 3, 0.0D, {total(f'(-{h} + ln({h}) / 2 - {lit(math.lgamma(1.5))})', f'(({df}) - 3) / 2', 'i + 1.5D')}))"
    else:
        even = f"list_sum(list_transform(range(0, CAST(({df}) // 2 AS BIGINT)), lambda i: exp(i * ln({h}) - {h} - lgamma(i + 1))))"
        odd = (f"({erfc_sql(f'sqrt({h})')} + coalesce(list_sum(list_transform(range(0, CAST((({df}) - 1) // 2 AS BIGINT)), "
               f"lambda j: exp((j + 0.5) * ln({h}) - {h} - lgamma(j + 1.5)))), 0))")
    return (f"(CASE WHEN ({df}) IS NULL OR ({x}) IS NULL OR ({df}) < 1 THEN NULL WHEN ({x}) <= 0 THEN 1.0E0 "
            f"WHEN ({df}) % 2 = 0 THEN least(1.0E0, {even}) ELSE least(1.0E0, greatest(0.0E0, {odd})) END)")


# ln k! + k - (k + 1/2) ln k - ln(2 pi) / 2: Stirling's error, in full up to 15, by its series beyond
_STIRLING = [math.lgamma(k + 1) + k - (k + 0.5) * math.log(k) - 0.5 * math.log(2 * math.pi) for k in range(1, 16)]


def _stirling_sql(k: str) -> str:
    table = " ".join(f"WHEN {i + 1} THEN {lit(v)}" for i, v in enumerate(_STIRLING))
    series = f"((1.0D / 12 - (1.0D / 360 - (1.0D / 1260 - 1.0D / 1680 / ({k} * {k})) / ({k} * {k})) / ({k} * {k})) / {k})"
    return f"(CASE CAST({k} AS BIGINT) {table} ELSE {series} END)"


def binomial_half_tail_sql(n: str, k: str) -> str:
    """Spark text: P(X <= k) for X ~ Binomial(n, 1/2), k <= n / 2, exact to double precision at every size.

    The largest term comes from its saddle-point form (no cancelling of large logarithms); the others follow by their ratio,
    which falls off so fast that past 6 sqrt(n) + 60 terms nothing is added in double precision."""
    nd, kd = f"CAST({n} AS DOUBLE)", f"CAST({k} AS DOUBLE)"
    m = f"({nd} - {kd})"
    dev = f"({kd} * ln(2 * {kd} / {nd}) + {m} * ln(2 * {m} / {nd}))"
    top = (f"IF({k} = 0, exp(-{nd} * ln(2.0D)), exp({_stirling_sql(nd)} - {_stirling_sql(kd)} - {_stirling_sql(m)} - {dev}"
           f" + ln({nd} / ({lit(2 * math.pi)} * {kd} * {m})) / 2))")
    terms = f"CAST(least({kd}, 6 * sqrt({nd}) + 60) AS INT)"
    return (f"({top} * aggregate(sequence(0, {terms}), named_struct('t', 1.0D, 's', 0.0D), (a, i) -> named_struct("
            f"'t', a.t * ({kd} - i) / ({m} + i + 1), 's', a.s + a.t), a -> a.s))")


def expr(sql: str) -> Column:
    return F.expr(sql)
