"""DuckDB text of the histogram bootstrap, shared by the resampling and paired-test queries."""

from __future__ import annotations

from ..functions.random import draw_sql, normal_sql

MODEL_A, MODEL_B = "m0", "m1"
B_MEDIAN = 1_000     # replicates used for the median-difference interval
MEDIAN_SEED = 123


def drawn_sql(cells: str, keys: list[str], cell: list[str], count: str, b: int, seed: int) -> str:
    """DuckDB CTE body: the cells for each replicate b with drawn counts m."""
    h = "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in (*keys, *cell)) + ", CAST(b AS VARCHAR)))"
    return (f"SELECT {', '.join((*keys, *cell))}, b, {draw_sql(count, 'z')} AS m FROM (SELECT *, {normal_sql('h', 'duckdb')} AS z "
            f"FROM (SELECT *, {h} AS h FROM {cells} CROSS JOIN (SELECT unnest(range(0, {b})) AS b) r) d) e")


def interval_sql(keys: list[str], extra: str = "") -> str:
    return (f"SELECT {', '.join(keys)}, quantile_cont(stat, 0.025) AS ci_low, quantile_cont(stat, 0.975) AS ci_high, avg(stat) AS boot_mean, "
            f"count(*) AS n_boot{extra} FROM reps WHERE stat IS NOT NULL GROUP BY ALL")


def hist_sql(src: str, keys: list[str], value: str, b: int, seed: int, stat: str = "mean", where: str = "") -> str:
    """DuckDB text of ``bootstrap_hist``."""
    K = ", ".join(keys)
    head = f"WITH {where} cells AS (SELECT {K}, CAST({value} AS DOUBLE) AS v, count(*) AS c FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL), draws AS ({drawn_sql('cells', keys, ['v'], 'c', b, seed)}),"
    if stat == "mean":
        body = f"""reps AS (SELECT {K}, b, sum(m * v) / nullif(sum(m), 0) AS stat FROM draws GROUP BY ALL),
est AS (SELECT {K}, sum(c * v) / sum(c) AS estimate FROM cells GROUP BY ALL)"""
    else:
        med = "SELECT {0}, (min(v) FILTER (WHERE cum > (n - 1) // 2) + min(v) FILTER (WHERE cum > n // 2)) / 2 AS {1} FROM (SELECT *, sum({2}) OVER (PARTITION BY {0} ORDER BY v) AS cum, sum({2}) OVER (PARTITION BY {0}) AS n FROM {3}) w GROUP BY ALL".format
        body = f"reps AS ({med(K + ', b', 'stat', 'm', 'draws')}), est AS ({med(K, 'estimate', 'c', 'cells')})"
    return f"{head} {body}, ci AS ({interval_sql(keys)}) SELECT * FROM est JOIN ci USING ({K})"


def median_diff_sql(analysis_sql: str, keys: tuple[str, ...] = ("evaluator", "metric")) -> str:
    """Interval of the median paired difference, model B minus model A."""
    K = ", ".join(keys)
    pairs = (f"(SELECT {K}, case_id, max(CASE WHEN model = '{MODEL_B}' THEN score END) - max(CASE WHEN model = '{MODEL_A}' THEN score END) AS d "
             f"FROM ({analysis_sql}) an GROUP BY {K}, case_id)")
    return hist_sql(pairs, list(keys), "d", B_MEDIAN, MEDIAN_SEED, "median")
