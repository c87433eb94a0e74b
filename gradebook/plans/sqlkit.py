"""DuckDB text builders shared by several oracle statements (kappa, Wilcoxon, ICC, BH)."""

from __future__ import annotations

from ..functions.stats import chi2_sf_sql, normal_two_sided_p_sql


def _k(keys: list[str], t: str = "") -> str:
    return ", ".join(f"{t}{k}" if t else k for k in keys)


def _on(keys: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def kappa_ctes(cells: str, keys: list[str], weights: str | None, out: str) -> str:
    """CTE chain ending in ``out(keys..., n, kappa)`` from ``cells(keys..., x, y, n)``."""
    K = _k(keys)
    if weights is None:
        w = "CASE WHEN ix = iy THEN 0.0 ELSE 1.0 END"
    elif weights == "linear":
        w = "abs(CAST(ix - iy AS DOUBLE))"
    else:
        w = "(CAST(ix - iy AS DOUBLE) * CAST(ix - iy AS DOUBLE))"
    p = out
    return f"""{p}_labs AS (SELECT DISTINCT {K}, lab FROM (SELECT {K}, x AS lab FROM {cells} UNION ALL SELECT {K}, y AS lab FROM {cells}) u),
{p}_idx AS (SELECT {K}, lab, dense_rank() OVER (PARTITION BY {K} ORDER BY lab) AS idx FROM {p}_labs),
{p}_c AS (SELECT {_k(keys, 'c.')}, c.n, i1.idx AS ix, i2.idx AS iy FROM {cells} c
   JOIN {p}_idx i1 ON {_on(keys, 'i1', 'c')} AND i1.lab = c.x JOIN {p}_idx i2 ON {_on(keys, 'i2', 'c')} AND i2.lab = c.y),
{p}_obs AS (SELECT {K}, sum(n) AS n, sum({w} * n) AS wo FROM {p}_c GROUP BY {K}),
{p}_r AS (SELECT {K}, ix, sum(n) AS r FROM {p}_c GROUP BY {K}, ix),
{p}_cl AS (SELECT {K}, iy, sum(n) AS c FROM {p}_c GROUP BY {K}, iy),
{p}_e AS (SELECT {_k(keys, 'r.')}, sum({w} * r * c) AS we_n FROM {p}_r r JOIN {p}_cl cl ON {_on(keys, 'r', 'cl')} GROUP BY {_k(keys, 'r.')}),
{out} AS (SELECT {_k(keys, 'o.')}, CAST(o.n AS BIGINT) AS n,
   CASE WHEN e.we_n / o.n > 0 THEN 1 - o.wo / (e.we_n / o.n) END AS kappa
   FROM {p}_obs o JOIN {p}_e e ON {_on(keys, 'o', 'e')})"""


def wilcoxon_ctes(pairs: str, keys: list[str], out: str) -> str:
    """``pairs(keys..., x, y)`` -> ``out(keys..., n_pairs, n, w_pos, w_neg, statistic, z, p_value, rank_biserial, method)``; ``p_value`` is the normal one,
    ``method`` says which one the automatic choice takes."""
    K = _k(keys)
    p = out
    z = "z"
    return f"""{p}_d AS (SELECT {K}, CAST(y AS DOUBLE) - CAST(x AS DOUBLE) AS d FROM {pairs} WHERE x IS NOT NULL AND y IS NOT NULL),
{p}_h AS (SELECT {K}, abs(d) AS ad, count_if(d > 0) AS pos, count_if(d < 0) AS neg, count(*) AS cnt,
          CASE WHEN abs(d) > 0 THEN count(*) ELSE 0 END AS t FROM {p}_d GROUP BY {K}, abs(d)),
{p}_r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY {K} ORDER BY ad ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          + (t + 1) / 2.0 AS avg_rank FROM {p}_h),
{p}_g AS (SELECT {K}, CAST(sum(cnt) AS BIGINT) AS n_pairs, CAST(sum(t) AS BIGINT) AS n,
          sum(CASE WHEN t > 0 THEN avg_rank * pos ELSE 0.0 END) AS w_pos, sum(CASE WHEN t > 0 THEN avg_rank * neg ELSE 0.0 END) AS w_neg,
          sum(power(t, 3) - t) AS tie_term FROM {p}_r GROUP BY {K}),
{p}_z AS (SELECT *, least(w_pos, w_neg) AS statistic,
          CASE WHEN n > 0 AND (CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0) > 0
               THEN (least(w_pos, w_neg) - CAST(n AS DOUBLE) * (n + 1) / 4.0) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0) END AS z
          FROM {p}_g),
{out} AS (SELECT {K}, n_pairs, n, w_pos, w_neg, statistic, z,
          CASE WHEN n = 0 THEN 1.0 ELSE {normal_two_sided_p_sql(z)} END AS p_value,
          CASE WHEN n > 0 THEN (w_pos - w_neg) / (CAST(n AS DOUBLE) * (n + 1) / 2.0) END AS rank_biserial,
          CASE WHEN n = 0 OR (n_pairs <= 50 AND n = n_pairs AND tie_term = 0) THEN 'exact' ELSE 'approx' END AS method FROM {p}_z)"""


def icc_ctes(long: str, keys: list[str], out: str) -> str:
    """``long(keys..., target, rater, v)`` complete by construction -> ``out(keys..., n, k, icc2_1, icc2_k)``."""
    K = _k(keys)
    p = out
    return f"""{p}_t AS (SELECT {K}, target, sum(v) AS t FROM {long} GROUP BY {K}, target),
{p}_st AS (SELECT {K}, sum(t * t) AS st2, count(*) AS n FROM {p}_t GROUP BY {K}),
{p}_rr AS (SELECT {K}, rater, sum(v) AS r FROM {long} GROUP BY {K}, rater),
{p}_sr AS (SELECT {K}, sum(r * r) AS sr2, count(*) AS k FROM {p}_rr GROUP BY {K}),
{p}_tot AS (SELECT {K}, sum(v) AS s, sum(v * v) AS q, count(*) AS nn FROM {long} GROUP BY {K}),
{p}_ss AS (SELECT {_k(keys, 'a.')}, a.n, b.k,
     a.st2 / CAST(b.k AS DOUBLE) - c.s * c.s / c.nn AS ss_t, b.sr2 / CAST(a.n AS DOUBLE) - c.s * c.s / c.nn AS ss_r, c.q - c.s * c.s / c.nn AS ss_tot
     FROM {p}_st a JOIN {p}_sr b ON {_on(keys, 'a', 'b')} JOIN {p}_tot c ON {_on(keys, 'a', 'c')}),
{p}_ms AS (SELECT {K}, n, k, ss_t / (CAST(n AS DOUBLE) - 1) AS ms_t, ss_r / (CAST(k AS DOUBLE) - 1) AS ms_r,
     (ss_tot - ss_t - ss_r) / ((CAST(n AS DOUBLE) - 1) * (CAST(k AS DOUBLE) - 1)) AS ms_e FROM {p}_ss),
{out} AS (SELECT {K}, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k,
     CASE WHEN n >= 2 AND k >= 2 THEN (ms_t - ms_e) / (ms_t + (CAST(k AS DOUBLE) - 1) * ms_e + CAST(k AS DOUBLE) * (ms_r - ms_e) / CAST(n AS DOUBLE)) END AS icc2_1,
     CASE WHEN n >= 2 AND k >= 2 THEN (ms_t - ms_e) / (ms_t + (ms_r - ms_e) / CAST(n AS DOUBLE)) END AS icc2_k FROM {p}_ms)"""


def bh_ctes(src: str, p_col: str, out: str, family: list[str] | None = None, alpha: float = 0.05,
            adj: str = "p_adj", flag: str = "reject") -> str:
    part = f"PARTITION BY {', '.join(family)}" if family else ""
    return f"""{out}_rk AS (SELECT *, count(*) OVER ({part}) AS _m, row_number() OVER ({part} ORDER BY {p_col}) AS _rank
     FROM {src} WHERE {p_col} IS NOT NULL),
{out}_adj AS (SELECT * EXCLUDE (_m, _rank, _raw), min(_raw) OVER ({part} ORDER BY _rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {adj}
     FROM (SELECT *, least(1.0, {p_col} * _m / _rank) AS _raw FROM {out}_rk) r),
{out} AS (SELECT *, {adj} <= {alpha} AS {flag} FROM {out}_adj
     UNION ALL SELECT *, CAST(NULL AS DOUBLE) AS {adj}, CAST(NULL AS BOOLEAN) AS {flag} FROM {src} WHERE {p_col} IS NULL)"""


def chi2_ctes(cells: str, keys: list[str], out: str) -> str:
    K = _k(keys)
    p = out
    return f"""{p}_xs AS (SELECT DISTINCT {K}, x FROM {cells}), {p}_ys AS (SELECT DISTINCT {K}, y FROM {cells}),
{p}_dense AS (SELECT {_k(keys, 'a.')}, a.x, b.y, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM {p}_xs a JOIN {p}_ys b ON {_on(keys, 'a', 'b')}
     LEFT JOIN {cells} c ON {_on(keys, 'c', 'a')} AND c.x = a.x AND c.y = b.y),
{p}_sh AS (SELECT {K}, min(n) = 0 AS has_zero, count(DISTINCT x) AS r, count(DISTINCT y) AS c FROM {p}_dense GROUP BY {K}),
{p}_o AS (SELECT d.*, CAST(d.n AS DOUBLE) + CASE WHEN s.has_zero THEN 0.5 ELSE 0.0 END AS o, s.r, s.c FROM {p}_dense d JOIN {p}_sh s ON {_on(keys, 'd', 's')}),
{p}_e AS (SELECT *, sum(o) OVER (PARTITION BY {K}, x) * sum(o) OVER (PARTITION BY {K}, y) / sum(o) OVER (PARTITION BY {K}) AS e FROM {p}_o),
{p}_s AS (SELECT {K}, sum((o - e) * (o - e) / e) AS statistic, CAST((max(r) - 1) * (max(c) - 1) AS INT) AS df FROM {p}_e GROUP BY {K}),
{out} AS (SELECT {K}, statistic, df, {chi2_sf_sql('statistic', 'df')} AS p_value FROM {p}_s)"""
