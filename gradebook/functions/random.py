"""Deterministic pseudo-random expressions that evaluate identically in Spark SQL and DuckDB.

Written as SQL text so the same string serves Spark (``F.expr``) and the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus of the fixture's square-mod scrambler (see FIXTURES.md).
SQMOD_P = 1000003


def sqmod_sql(x: str) -> str:
    """``((x) % p) * ((x) % p) % p``: integer scrambler used by the fixture views."""
    return f"((({x}) % {SQMOD_P}) * (({x}) % {SQMOD_P}) % {SQMOD_P})"


def sqmod(x: Column) -> Column:
    m = x % F.lit(SQMOD_P)
    return (m * m) % F.lit(SQMOD_P)


def uniform_sql(*parts: str, dialect: str = "spark") -> str:
    """Seeded uniform in [0, 1) from the first 52 bits of md5(concat_ws('|', parts)): one of as many numbers as a double tells
    apart there, so that ``floor(u * n)`` reaches every index of up to 2^52.

    Spark and DuckDB render the same number (hex digits → integer → / 2^52)."""
    key = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" if dialect == "duckdb" else f"CAST({p} AS STRING)" for p in parts) + ")"
    if dialect == "duckdb":
        return f"(CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"
    return f"(CAST(conv(substr(md5({key}), 1, 13), 16, 10) AS BIGINT) / 4503599627370496.0D)"


def uniform(*parts: str) -> Column:
    return F.expr(uniform_sql(*parts, dialect="spark"))


def normal_sql(h: str, dialect: str = "spark") -> str:
    """Standard normal by Box-Muller from the first two words of the md5 hex ``h``."""
    def u(at: int) -> str:
        if dialect == "duckdb":
            return f"(CAST(('0x' || substr({h}, {at}, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"
        return f"(CAST(conv(substr({h}, {at}, 8), 16, 10) AS BIGINT) / 4294967296.0D)"
    one = "1.1641532182693481E-10"  # 2^-33 keeps the logarithm finite
    return f"(sqrt(-2 * ln({u(1)} + {one})) * cos(6.283185307179586E0 * {u(9)}))"


def draw_sql(count: str, z: str) -> str:
    """Poisson-like draw for a cell count from a normal z: the Cornish-Fisher count (both dialects)."""
    return f"CAST(greatest(0, floor({count} + sqrt(CAST({count} AS DOUBLE)) * {z} + ({z} * {z} - 1) / 6 + 0.5)) AS BIGINT)"


# ---------------------------------------------------------------- keyed bijections of 0 .. n-1
#
# A number x = l * b + r is a cell of an a by b grid with a * b >= n, a = ceil(sqrt(n)).  A round adds to one coordinate a keyed hash of
# the other, modulo its length, which can be undone, so any number of rounds is a bijection of the grid.  A result of n or more
# is put through the rounds again until it is below n (cycle walking): that ends, as the cycle leads back to x < n, and the
# grid has fewer than a cells too many, so that of n numbers about sqrt(n) need a second walk.
PRIME = 2147483647                            # fixed value: 2^31 - 1; products of two residues fit 64 bits
MULTIPLIERS = (48271, 16807, 69621, 39373)    # one for each round


def key_word_sql(*parts: str, dialect: str = "spark") -> str:
    """The first 60 bits of md5(concat_ws('|', parts)) as a whole number."""
    cast = "VARCHAR" if dialect == "duckdb" else "STRING"
    h = "substr(md5(concat_ws('|', " + ", ".join(f"CAST({p} AS {cast})" for p in parts) + ")), 1, 15)"
    return f"CAST(('0x' || {h}) AS BIGINT)" if dialect == "duckdb" else f"CAST(conv({h}, 16, 10) AS BIGINT)"


def grid_sql(n: str, dialect: str = "spark") -> tuple[str, str]:
    """Sides a and b of the grid for n numbers."""
    a = f"CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT)"
    return a, (f"(({n} + {a} - 1) // {a})" if dialect == "duckdb" else f"(({n} + {a} - 1) div {a})")


def round_sql(k: int, add_to: str, other: str, side: str, u: str = "u", v: str = "v") -> str:
    """Round k: the coordinate ``add_to`` of length ``side``, moved by a hash of ``other`` under the key words u and v (below ``PRIME``)."""
    t = f"(({other} * {MULTIPLIERS[k]} + {u} + {k} * {v}) % {PRIME})"
    q = f"(({t} * {t} + {t}) % {PRIME})"
    return f"(({add_to} + ({q} * {q} + {q}) % {PRIME}) % {side})"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def walk_sql(y: str, a: str, b: str, u: str, v: str) -> str:
    """Spark text: all rounds on the number ``y``, as one expression."""
    out = "l2 * {b} + r2".format(b=b)
    for k, (name, add_to, other, side) in reversed(list(enumerate([("l1", "l0", "r0", a), ("r1", "r0", "l1", b), ("l2", "l1", "r1", a), ("r2", "r1", "l2", b)]))):
        out = _let(round_sql(k, add_to, other, side, u, v), name, out)
    return _let(f"{y} div {b}", "l0", _let(f"{y} % {b}", "r0", out))


def bijection_duckdb_sql(src: str, number: str, n: str, keys, seed: int, name: str) -> str:
    """DuckDB text of ``ranking.bijection`` on the rows of ``src``: key words once for each group, the four rounds as nested
    statements, further walks by recursion."""
    K = ", ".join(keys)
    word = key_word_sql(f"'{seed}'", *keys, dialect="duckdb")
    a, b = grid_sql(n, "duckdb")

    def rounds(rows: str, y: str) -> str:
        q = f"SELECT *, {y} // gb AS l, {y} % gb AS r FROM ({rows}) w"
        for k in range(4):
            side, other = (("l", "r") if k % 2 == 0 else ("r", "l"))
            for level, e in (("t", f"({other} * {MULTIPLIERS[k]} + u + {k} * v) % {PRIME}"), ("q", f"(t * t + t) % {PRIME}"), ("h", f"(q * q + q) % {PRIME}")):
                q = f"SELECT *, {e} AS {level} FROM ({q}) {level}{k}"
            q = f"SELECT * EXCLUDE (t, q, h) REPLACE (({side} + h) % {'ga' if side == 'l' else 'gb'} AS {side}) FROM ({q}) k{k}"
        return f"SELECT * EXCLUDE (l, r), l * gb + r AS y FROM ({q}) z"

    first = f"SELECT s.*, k.u, k.v, {a} AS ga, {b} AS gb FROM {src} s JOIN kw k USING ({K})"
    return (f"WITH RECURSIVE kw AS MATERIALIZED (SELECT *, word % {PRIME} AS u, word // {PRIME} % {PRIME} AS v FROM (SELECT {K}, {word} AS word FROM (SELECT DISTINCT {K} FROM {src}) g) h), "
            f"walk AS ({rounds(first, number)} UNION ALL SELECT * EXCLUDE (y0) FROM ({rounds(f'SELECT * EXCLUDE (y), y AS y0 FROM walk WHERE y >= {n}', 'y0')}) again) "
            f"SELECT * EXCLUDE (u, v, ga, gb, y), y AS {name} FROM walk WHERE y < {n}")
