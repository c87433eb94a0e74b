"""Tests, intervals, effect sizes and multiple-testing correction.

Rule: Spark reduces rows to small sufficient statistics (counts, cells, value histograms);
the closed-form statistic then runs on those result rows as SQL expressions
(``functions.stats``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import binomial_half_tail_sql, chi2_sf_sql, erfc_sql, lit, normal_two_sided_p_sql, wilson_sql

def wilson(df: DataFrame, k: str, n: str, prefix: str = "") -> DataFrame:
    lo, hi = wilson_sql(k, n)
    return df.withColumns({f"{prefix}ci_low": F.expr(lo), f"{prefix}ci_high": F.expr(hi)})


def mcnemar_p_spark_sql(b: str, c: str) -> str:
    """Exact two-sided McNemar p (binomial, p = 0.5) at every size; no discordant pair gives 1."""
    return f"(CASE WHEN {b} + {c} = 0 THEN 1.0D ELSE least(1.0D, 2 * {binomial_half_tail_sql(f'({b} + {c})', f'least({b}, {c})')}) END)"


def mcnemar_p_duckdb_sql(b: str, c: str) -> str:
    n = f"({b} + {c})"
    return (f"least(1.0, 2 * list_sum(list_transform(range(0, CAST(least({b}, {c}) AS BIGINT) + 1), lambda i: "
            f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0)))))")


def mcnemar_exact(p: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """T2 on paired booleans (x, y): b = x and not y, c = y and not x."""
    out = p.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(x) & ~F.col(y)).alias("n_10"),
        F.count_if(~F.col(x) & F.col(y)).alias("n_01"),
    )
    return out.withColumn("p_value", F.expr(mcnemar_p_spark_sql("n_10", "n_01")))


def chi2_association(cells: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", shift_zeros: bool = True) -> DataFrame:
    """Pearson chi-square independence on the dense r x c crosstab of observed labels.

    With ``shift_zeros`` 0.5 is added to every cell when any cell of the dense table is zero (K3).
    Works on the per-group cell array (bounded by labels^2): the dense table, marginals and the
    statistic are higher-order-function expressions on one row per group."""
    from .agreement import cell_arrays
    keys = list(keys)
    a = cell_arrays(cells, keys, x, y).withColumns({
        "xs": F.expr("array_sort(array_distinct(transform(cs, c -> c.x)))"),
        "ys": F.expr("array_sort(array_distinct(transform(cs, c -> c.y)))"),
    })
    shift = "IF(size(cs) < size(xs) * size(ys), 0.5D, 0.0D)" if shift_zeros else "0.0D"
    a = a.withColumns({
        "s": F.expr(shift),
        "nn": F.expr("aggregate(cs, 0.0D, (acc, c) -> acc + c.n)"),
        "rs": F.expr("transform(xs, l -> aggregate(filter(cs, c -> c.x = l), 0.0D, (acc, c) -> acc + c.n))"),
        "cl": F.expr("transform(ys, l -> aggregate(filter(cs, c -> c.y = l), 0.0D, (acc, c) -> acc + c.n))"),
    })
    o = ("(aggregate(filter(cs, c -> c.x = element_at(xs, i) AND c.y = element_at(ys, j)), 0.0D, (acc, c) -> acc + c.n) + s)")
    e = "((element_at(rs, i) + size(ys) * s) * (element_at(cl, j) + size(xs) * s) / (nn + size(xs) * size(ys) * s))"
    stat = (f"aggregate(sequence(1, size(xs)), 0.0D, (acc, i) -> acc + aggregate(sequence(1, size(ys)), 0.0D, "
            f"(acc2, j) -> acc2 + ({o} - {e}) * ({o} - {e}) / {e}))")
    out = a.select(*keys, F.expr(stat).alias("statistic"),
                   ((F.size("xs") - 1) * (F.size("ys") - 1)).cast("int").alias("df"))
    return out.withColumn("p_value", F.expr(chi2_sf_sql("statistic", "df", "spark")))


def stuart_maxwell(cells: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """T4: marginal homogeneity X^2 = d' S^-1 d on k-1 labels (labels with zero marginals dropped).

    Works on the per-group cell array (at most labels^2 entries): the matrix [S | d] is reduced row by row (S is positive
    semi-definite, so no pivoting); the statistic is the sum of squared reduced d over the pivots.  A pivot of zero
    (labels that never change) makes it NULL.  Keys keep their types."""
    from .agreement import cell_arrays
    keys = list(keys)
    a = cell_arrays(cells.where("n > 0"), keys, x, y).withColumn("ls", F.expr("array_sort(array_distinct(concat(transform(cs, c -> c.x), transform(cs, c -> c.y))))"))
    n = "aggregate(filter(cs, c -> {}), 0.0D, (s, c) -> s + c.n)".format
    row, col = n("c.x = li"), n("c.y = li")
    off = n("(c.x = li AND c.y = lj) OR (c.x = lj AND c.y = li)")
    matrix = (f"transform(slice(ls, 1, size(ls) - 1), li -> concat(transform(slice(ls, 1, size(ls) - 1), lj -> "
              f"IF(li = lj, {row} + {col} - 2 * {n('c.x = li AND c.y = li')}, -({off}))), array({row} - ({col}))))")
    a = a.select(*keys, (F.size("ls") - 1).alias("df"), F.expr(f"IF(size(ls) < 2, array(array(0.0D)), {matrix})").alias("m"))
    # step p: rows below lose their entry in column p; the last column carries d
    step = ("named_struct('m', transform(acc.m, (r, i) -> IF(i <= p, r, transform(r, (v, j) -> v - acc.m[p][j] * r[p] / nullif(acc.m[p][p], 0.0D)))), "
            "'s', acc.s + acc.m[p][size(acc.m)] * acc.m[p][size(acc.m)] / IF(acc.m[p][p] > 1e-9, acc.m[p][p], NULL))")
    stat = f"IF(df < 1, NULL, aggregate(sequence(0, df - 1), named_struct('m', m, 's', 0.0D), (acc, p) -> {step}, acc -> acc.s))"
    return a.select(*keys, F.expr(stat).alias("statistic"), "df").withColumn("p_value", F.expr(chi2_sf_sql("statistic", "df", "spark")))


EXACT_PAIRS = 50   # fixed value: ``auto`` takes the exact null up to so many pairs


def _signed_rank_cdf(steps: str, t: str) -> str:
    """Spark text: P(sum <= t) of the sum of ``steps`` (an array of whole numbers), each taken with probability 1/2.

    Entry s of the array is the probability of the sum s; a step k adds the array moved by k.  Sums over t are cut off at once,
    as no later step lowers a sum, so the array has at most t + 1 entries."""
    moved = "zip_with(concat(c, array_repeat(0.0D, k)), concat(array_repeat(0.0D, k), c), (p, q) -> (p + q) / 2)"
    return f"aggregate({steps}, array(1.0D), (c, k) -> slice({moved}, 1, {t} + 1), c -> aggregate(c, 0.0D, (s, p) -> s + p))"


def wilcoxon_signed_rank(p: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", method: str = "auto") -> DataFrame:
    """T5/T6 on paired values (y - x), zeros dropped (Wilcoxon's method), two-sided.

    Histogram form: counts per |d| with positive / negative split, average ranks from the
    cumulative count of smaller |d| (a window over the distinct |d| values of one group),
    W+ / W-, T = min, tie-corrected normal z (no continuity correction).

    ``method``: ``approx`` takes p = erfc(|z|/sqrt 2); ``exact`` the distribution of the rank sum over all signs, by dynamic
    programming (ties: over the signs of the average ranks at hand; time n * T, memory T a group, so for small
    groups); ``auto`` is exact for at most ``EXACT_PAIRS`` pairs without ties and zeros, else approximate.  The column
    ``method`` says which one a group got.  Groups whose differences are all zero give statistic 0 and p 1 (exact)."""
    if method not in ("auto", "exact", "approx"):
        raise ValueError("method is auto, exact or approx")
    keys = list(keys)
    d = p.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, (F.col(y).cast("double") - F.col(x).cast("double")).alias("d"))
    h = d.groupBy(*keys, F.abs("d").alias("ad")).agg(
        F.count_if(F.col("d") > 0).alias("pos"), F.count_if(F.col("d") < 0).alias("neg"), F.count("*").alias("cnt"))
    h = h.withColumn("t", F.when(F.col("ad") > 0, F.col("cnt")).otherwise(0))
    w = Window.partitionBy(*keys).orderBy("ad").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0)))
    h = h.withColumn("avg_rank", F.col("before") + (F.col("t") + 1) / 2.0)
    # ranks in halves are whole numbers; only the exact method needs them
    ranks = [F.collect_list(F.when(F.col("t") > 0, F.struct((2 * F.col("before") + F.col("t") + 1).cast("int").alias("r"), F.col("t").cast("int").alias("t")))).alias("_ranks")]
    g = h.groupBy(*keys).agg(
        F.sum("cnt").alias("n_pairs"),
        F.sum("t").alias("n"),
        F.sum(F.when(F.col("t") > 0, F.col("avg_rank") * F.col("pos")).otherwise(0.0)).alias("w_pos"),
        F.sum(F.when(F.col("t") > 0, F.col("avg_rank") * F.col("neg")).otherwise(0.0)).alias("w_neg"),
        F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie_term"),
        *(ranks if method == "exact" else []),
    )
    n = F.col("n").cast("double")
    g = g.withColumns({
        "statistic": F.least("w_pos", "w_neg"),
        "_mean": n * (n + 1) / 4.0,
        "_var": n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie_term") / 48.0,
    })
    g = g.withColumn("z", F.when((F.col("n") > 0) & (F.col("_var") > 0), (F.col("statistic") - F.col("_mean")) / F.sqrt("_var")))
    untied = (F.col("tie_term") == 0) & (F.col("n") == F.col("n_pairs"))
    chosen = {"exact": F.lit(True), "approx": F.lit(False), "auto": untied & (F.col("n_pairs") <= EXACT_PAIRS)}[method]
    if method == "exact":
        cdf = _signed_rank_cdf("flatten(transform(_ranks, x -> array_repeat(x.r, x.t)))", "CAST(2 * statistic AS INT)")
    else:
        cdf = _signed_rank_cdf("sequence(1, CAST(n AS INT))", "CAST(statistic AS INT)")
    g = g.withColumn("method", F.when((F.col("n") == 0) | chosen, "exact").otherwise("approx"))
    approx = F.expr(normal_two_sided_p_sql("z"))
    exact = F.least(F.lit(1.0), 2 * F.expr(cdf)) if method != "approx" else approx
    g = g.withColumns({
        "p_value": F.when(F.col("n") == 0, F.lit(1.0)).when(F.col("method") == "exact", exact).otherwise(approx),
        "rank_biserial": F.when(F.col("n") > 0, (F.col("w_pos") - F.col("w_neg")) / (n * (n + 1) / 2.0)),
    })
    return g.drop("_mean", "_var", "tie_term", "_ranks")


def fdr_bh(df: DataFrame, p_col: str = "p_value", family: Sequence[str] = (), alpha: float = 0.05,
           out: str = "p_adj", flag: str = "reject") -> DataFrame:
    """T8 Benjamini-Hochberg over each family (default: all rows); NULL p excluded and kept NULL.

    Runs over result rows (one per test), so the window over a family is small."""
    fam = list(family)
    valid = df.filter(F.col(p_col).isNotNull())
    nulls = df.filter(F.col(p_col).isNull())
    wspec = Window.partitionBy(*fam) if fam else Window.partitionBy()
    ranked = valid.withColumns({
        "_m": F.count("*").over(wspec),
        "_rank": F.row_number().over(wspec.orderBy(F.col(p_col))),
    })
    ranked = ranked.withColumn("_raw", F.least(F.lit(1.0), F.col(p_col) * F.col("_m") / F.col("_rank")))
    run = wspec.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn(out, F.min("_raw").over(run)).withColumn(flag, F.col(out) <= alpha)
    ranked = ranked.drop("_m", "_rank", "_raw")
    return ranked.unionByName(nulls.withColumns({out: F.lit(None).cast("double"), flag: F.lit(None).cast("boolean")}))


def t_interval(df: DataFrame, keys: Sequence[str], value: str, t_quantile: float) -> DataFrame:
    """Mean +- t * sd / sqrt(n) of a per-run statistic."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    half = F.lit(t_quantile) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return out.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def student_t_quantile(p: float, df: float) -> float:
    """Driver-side constant: Student-t quantile by bisection on the regularised incomplete beta."""
    def betacf(a, b, x):
        qab, qap, qam = a + b, a + 1.0, a - 1.0
        c, d = 1.0, 1.0 - qab * x / qap
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            m2 = 2 * m
            aa = m * (b - m) * x / ((qam + m2) * (a + m2))
            d = 1.0 + aa * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
            h *= d * c
            aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
            d = 1.0 + aa * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + aa / c if abs(1.0 + aa / c) > 1e-300 else 1e-300
            de = d * c
            h *= de
            if abs(de - 1.0) < 1e-16:
                break
        return h

    def ibeta(a, b, x):
        if x <= 0:
            return 0.0
        if x >= 1:
            return 1.0
        lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
        if x < (a + 1) / (a + b + 2):
            return math.exp(lbt) * betacf(a, b, x) / a
        return 1.0 - math.exp(lbt) * betacf(b, a, 1 - x) / b

    def cdf(t):
        x = df / (df + t * t)
        tail = 0.5 * ibeta(df / 2, 0.5, x)
        return 1 - tail if t > 0 else tail

    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


__all__ = ["wilson", "mcnemar_exact", "chi2_association", "stuart_maxwell", "wilcoxon_signed_rank", "fdr_bh",
           "t_interval", "student_t_quantile", "erfc_sql", "lit"]
