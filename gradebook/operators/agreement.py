"""Agreement operators (A16-A24): pairs, contingency cells, kappa family, ICC, rater agreement.

Values that belong to one case are brought side by side by ONE conditional aggregate over the known labels
(variants, models, raters), and pairs of labels are an explode of that row: one scan, one shuffle, no self-join, and a
fan-out bounded by labels^2 per case.  Every statistic then comes from the cells (x, y, n) of a group, at most labels^2
of them, as closed forms on one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rater_average(ratings: DataFrame, keys=("model", "case_id", "metric"), value: str = "score") -> DataFrame:
    """Mean over raters per (model, case, metric); NULL scores skipped."""
    return ratings.groupBy(*keys).agg(F.avg(value).alias(value))


def side_by_side(df: DataFrame, on: Sequence[str], label: str, labels: Sequence, values: Sequence[str]) -> DataFrame:
    """One row per ``on`` key with a struct of ``values`` for each label (NULL where the key has no such row)."""
    row = F.struct(*values)
    return df.groupBy(*on).agg(*[F.max(F.when(F.col(label) == v, row)).alias(f"_{i}") for i, v in enumerate(labels)])


def pairs(df: DataFrame, on: Sequence[str], label: str, value: str, labels: Sequence, extra: Sequence[str] = ()) -> DataFrame:
    """All unordered pairs of the given labels sharing the ``on`` key: (on..., a, b, x, y, extra_a..., extra_b...).

    A (key, label) has one row; pairs come in the order of ``labels``."""
    wide = side_by_side(df, on, label, labels, [value, *extra])
    made = []
    for i, a in enumerate(labels):
        for j in range(i + 1, len(labels)):
            p, q = F.col(f"_{i}"), F.col(f"_{j}")
            both = F.struct(F.lit(a).alias("a"), F.lit(labels[j]).alias("b"), p[value].alias("x"), q[value].alias("y"),
                            *[p[e].alias(f"{e}_a") for e in extra], *[q[e].alias(f"{e}_b") for e in extra])
            made.append(F.when(p.isNotNull() & q.isNotNull(), both))
    return wide.select(*on, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("_p")).select(*on, "_p.*")


def contingency(p: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", complete: bool = True) -> DataFrame:
    """Cells (keys..., x, y, n); ``complete`` drops pairs with a NULL side (pandas crosstab)."""
    if not complete:
        return p.groupBy(*keys, x, y).agg(F.count("*").alias("n"))
    # NULL sides are dropped by a conditional count on the aggregated rows, not by a Filter:
    # a Filter on the label would be pushed below the join and re-evaluate the label expression
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return p.groupBy(*keys, x, y).agg(F.count_if(both).alias("n")).filter(F.col("n") > 0)


def cell_arrays(cells: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """One row per group holding its cells as ``cs: array<struct<x, y, n>>``.

    Cells are already aggregated, so the array is bounded by (#labels)^2 per group -- not by
    rows -- and the closed-form statistics below run as higher-order functions on that row."""
    return cells.groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col("n"))).alias("cs"))


def _w_sql(i: str, j: str, weights: str | None) -> str:
    if weights is None:
        return f"IF({i} = {j}, 0.0D, 1.0D)"
    if weights == "linear":
        return f"abs(CAST({i} - {j} AS DOUBLE))"
    return f"(CAST({i} - {j} AS DOUBLE) * CAST({i} - {j} AS DOUBLE))"


def cohen_kappa(cells: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", weights: str | None = None) -> DataFrame:
    """Cohen's kappa per group from cells; ``weights`` None, 'linear' or 'quadratic'.

    kappa = 1 - sum(w*O) / sum(w*E), E = row * col / n, w on the index of the label in the sorted
    union of observed labels (K10).  With 0/1 weights this equals (po - pe) / (1 - pe).  NULL when
    sum(w*E) = 0 (pe = 1)."""
    a = with_kappa(cell_arrays(cells, list(keys), x, y), weights, "kappa")
    return a.select(*keys, F.expr("aggregate(cs, 0L, (acc, c) -> acc + c.n)").alias("n"), "kappa")


def with_kappa(a: DataFrame, weights: str | None, name: str) -> DataFrame:
    """``a`` (a row per group with its cells ``cs``) with Cohen's kappa as column ``name``."""
    labs = "array_sort(array_distinct(concat(transform(cs, c -> c.x), transform(cs, c -> c.y))))"
    kept = a.columns
    a = a.withColumn("labs", F.expr(labs))
    a = a.withColumns({
        "_n": F.expr("aggregate(cs, 0L, (acc, c) -> acc + c.n)"),
        "rs": F.expr("transform(labs, l -> aggregate(filter(cs, c -> c.x = l), 0L, (acc, c) -> acc + c.n))"),
        "cl": F.expr("transform(labs, l -> aggregate(filter(cs, c -> c.y = l), 0L, (acc, c) -> acc + c.n))"),
        "wo": F.expr(f"aggregate(cs, 0.0D, (acc, c) -> acc + "
                     f"{_w_sql('array_position(labs, c.x)', 'array_position(labs, c.y)', weights)} * c.n)"),
    })
    a = a.withColumn("we_n", F.expr(
        "aggregate(sequence(1, size(labs)), 0.0D, (acc, i) -> acc + aggregate(sequence(1, size(labs)), 0.0D, "
        f"(acc2, j) -> acc2 + {_w_sql('i', 'j', weights)} * element_at(rs, i) * element_at(cl, j)))"))
    we = F.col("we_n") / F.col("_n")
    return a.select(*kept, F.when(we > 0, 1 - F.col("wo") / we).alias(name))


def _icc(n: str, k: str, ms_t: str, ms_r: str, ms_e: str) -> tuple:
    """ICC(2,1) and ICC(2,k) from mean squares of targets, raters and error; NULL under two targets or raters."""
    kd, nd = f"CAST({k} AS DOUBLE)", f"CAST({n} AS DOUBLE)"
    single = f"({ms_t} - {ms_e}) / ({ms_t} + ({kd} - 1) * {ms_e} + {kd} * ({ms_r} - {ms_e}) / {nd})"
    average = f"({ms_t} - {ms_e}) / ({ms_t} + ({ms_r} - {ms_e}) / {nd})"
    return tuple(F.expr(f"IF({n} >= 2 AND {k} >= 2, {e}, NULL)") for e in (single, average))


def icc2(long: DataFrame, keys: Sequence[str], target: str = "case_id", rater: str = "evaluator", value: str = "score") -> DataFrame:
    """ICC(2,1) and ICC(2,k) for any number of raters, two-way random effects, absolute agreement, complete targets only.

    Sums of squares are taken of values centred on their group's mean, so a large common level costs no digits."""
    keys = list(keys)
    v = long.filter(F.col(value).isNotNull()).select(*keys, target, rater, F.col(value).cast("double").alias("_v"))
    group = v.groupBy(*keys).agg(F.count_distinct(rater).alias("_k"), F.avg("_v").alias("_g"))
    per_t = v.join(group, keys).withColumn("_v", F.col("_v") - F.col("_g")).groupBy(*keys, target, "_k") \
        .agg(F.count("*").alias("_m"), F.sum("_v").alias("_t"), F.sum(F.col("_v") * F.col("_v")).alias("_q"), F.collect_list(F.struct(rater, "_v")).alias("_vs"))
    complete = per_t.filter(F.col("_m") == F.col("_k"))
    per_r = complete.select(*keys, F.explode("_vs").alias("_x")).groupBy(*keys, F.col(f"_x.{rater}").alias("_r")).agg(F.sum("_x._v").alias("_s")) \
        .groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("_sr2"))
    j = complete.groupBy(*keys).agg(F.sum(F.col("_t") * F.col("_t")).alias("_st2"), F.sum("_q").alias("_q"), F.sum("_t").alias("_s"),
                                    F.count("*").alias("n"), F.max("_k").alias("k")).join(per_r, keys)
    cf = "_s * _s / (n * k)"
    j = j.withColumns({"_sst": F.expr(f"_st2 / k - {cf}"), "_ssr": F.expr(f"_sr2 / n - {cf}"), "_ss": F.expr(f"_q - {cf}")})
    j = j.select(*keys, F.col("n").cast("bigint").alias("n"), F.col("k").cast("bigint").alias("k"), F.expr("_sst / nullif(n - 1.0D, 0)").alias("_mt"),
                 F.expr("_ssr / nullif(k - 1.0D, 0)").alias("_mr"), F.expr("(_ss - _sst - _ssr) / nullif((n - 1.0D) * (k - 1.0D), 0)").alias("_me"))
    single, average = _icc("n", "k", "_mt", "_mr", "_me")
    return j.select(*keys, "n", "k", single.alias("icc2_1"), average.alias("icc2_k"))


def rater_pairs(ratings: DataFrame, keys: Sequence[str] = ("model", "metric"), r1: str = "user1", r2: str = "user2",
                value: str = "score", target: str = "case_id") -> DataFrame:
    """Complete (target) rows with both raters scored: (keys..., case_id, y1, y2), by one conditional aggregate."""
    on = list(dict.fromkeys([*keys, "metric", target]))
    wide = ratings.groupBy(*on).agg(*[F.max(F.when(F.col("evaluator") == r, F.col(value))).alias(y) for r, y in ((r1, "y1"), (r2, "y2"))])
    return wide.filter(F.col("y1").isNotNull() & F.col("y2").isNotNull())


def rater_cells(rp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group with the cells ``cs`` (x, y, n) of two raters' scores: all that agreement measures need."""
    cells = rp.groupBy(*keys, F.col("y1").cast("double").alias("x"), F.col("y2").cast("double").alias("y")).agg(F.count("*").alias("n"))
    return cell_arrays(cells, keys)


def _sum(term: str) -> str:
    return f"aggregate(cs, 0.0D, (acc, c) -> acc + c.n * ({term}))"


def rater_agreement(rp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact agreement share and mean absolute difference over complete pairs."""
    return _with_agreement(rater_cells(rp, keys)).select(*keys, "n", "exact_agreement", "mean_abs_difference")


def _with_agreement(a: DataFrame) -> DataFrame:
    a = a.withColumn("n", F.expr("aggregate(cs, 0L, (acc, c) -> acc + c.n)"))
    return a.withColumns({"exact_agreement": F.expr(f"{_sum('IF(c.x = c.y, 1.0D, 0.0D)')} / n"), "mean_abs_difference": F.expr(f"{_sum('abs(c.x - c.y)')} / n")})


def with_icc_of_two(a: DataFrame) -> DataFrame:
    """``a`` (rows with cells ``cs``) with n and the ICCs of two raters, from deviations of the grand mean."""
    kept = a.columns
    a = a.withColumn("_n", F.expr("aggregate(cs, 0L, (acc, c) -> acc + c.n)"))
    a = a.withColumns({"_x": F.expr(f"{_sum('c.x')} / _n"), "_y": F.expr(f"{_sum('c.y')} / _n")}).withColumn("_g", F.expr("(_x + _y) / 2"))
    a = a.withColumns({
        "_sst": F.expr(_sum("2 * power((c.x + c.y) / 2 - _g, 2)")), "_ssr": F.expr("_n * (power(_x - _g, 2) + power(_y - _g, 2))"),
        "_sse": F.expr(_sum("power(c.x - (c.x + c.y) / 2 - (_x - _g), 2) + power(c.y - (c.x + c.y) / 2 - (_y - _g), 2)"))})
    single, average = _icc("_n", "2", "(_sst / nullif(_n - 1, 0))", "_ssr", "(_sse / nullif(_n - 1, 0))")
    return a.select(*kept, single.alias("icc2_1"), average.alias("icc2_k"))


def _agreement_measures(a: DataFrame) -> DataFrame:
    a = _with_agreement(a)
    a = with_kappa(with_kappa(a, "quadratic", "quadratic_weighted_kappa"), "linear", "linear_weighted_kappa")
    return with_icc_of_two(a).withColumnRenamed("icc2_1", "icc2_1_single_rater").withColumnRenamed("icc2_k", "icc2_k_average_raters").drop("cs")


def agreement_table(rp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A20-A23 in one table, from one set of cells: exact agreement, MAD, weighted kappas, ICC(2,1), ICC(2,k)."""
    return _agreement_measures(rater_cells(rp, list(keys)))


def agreement_levels(rp: DataFrame, keys: Sequence[str], pooled: Sequence[str]) -> DataFrame:
    """A22 and A23 in one pass, by GROUPING SETS: ``agreement_table`` by ``keys`` and, with NULL in the other keys and ``is_pooled`` true,
    by the keys in ``pooled``."""
    keys = list(keys)
    c = rp.select(*keys, F.col("y1").cast("double").alias("x"), F.col("y2").cast("double").alias("y"))
    over = [k for k in keys if k not in pooled]
    sets = [[*keys, "x", "y"], [*pooled, "x", "y"]]
    cells = c.groupingSets(sets, *keys, "x", "y").agg(F.count("*").alias("n"), (F.grouping(over[0]) == 1).alias("is_pooled"))
    return _agreement_measures(cell_arrays(cells, [*keys, "is_pooled"]))


def gated_average(ratings: DataFrame, global_agreement: DataFrame, threshold: float = 0.75) -> DataFrame:
    """If every model's pooled quadratic kappa >= threshold, average the raters, else keep them.

    The gate is a scalar subquery over the (one row per model) agreement table; both outcomes come from one aggregate."""
    gate = global_agreement.agg(F.coalesce(F.bool_and(F.col("quadratic_weighted_kappa") >= threshold), F.lit(False)).alias("ok")).scalar()
    both = ratings.groupBy("model", "case_id", "metric").agg(F.avg("score").alias("_avg"), F.collect_list(F.struct("evaluator", "score")).alias("_all"))
    mean = F.array(F.struct(F.lit("average_user1_user2").alias("evaluator"), F.col("_avg").alias("score")))
    return both.withColumn("_ok", gate).select("model", "case_id", "metric", F.explode(F.when(F.col("_ok"), mean).otherwise(F.col("_all"))).alias("_r")) \
        .select("model", "case_id", "metric", "_r.evaluator", "_r.score")
