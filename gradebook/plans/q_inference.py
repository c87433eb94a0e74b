"""Catalogue: tests, effect sizes, corrections and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import chi2_sf_sql, wilson_sql
from ..operators import agreement as A
from ..operators import inference as I
from ..operators import resample as R
from ..operators import summary as S
from ..sources import fixtures as fx
from .catalog import register
from .common import REP_KEYS, graded_m2, graded_rep, graded_t0
from .q_summary import _likert_sql
from .q_agreement import GATED_SQL, VARIANT_PAIRS_SQL, global_agreement_df, variant_pairs
from .resample_sql import B_MEDIAN, MEDIAN_SEED, MODEL_A, MODEL_B, median_diff_sql
from .sqlkit import bh_ctes, chi2_ctes, kappa_ctes, wilcoxon_ctes

T_975_DF9 = I.student_t_quantile(0.975, 9)


@register("mcnemar_exact", views=("graded_t0",), doubles=("p_value",), sql=f"""
WITH s AS (SELECT model, a, b, count(*) AS n, count_if(correct_a AND NOT correct_b) AS n_10, count_if(NOT correct_a AND correct_b) AS n_01
           FROM ({VARIANT_PAIRS_SQL}) p GROUP BY ALL)
SELECT model, a, b, n, n_10, n_01, {I.mcnemar_p_duckdb_sql('n_10', 'n_01')} AS p_value FROM s""")
def mcnemar_exact(spark, sf):
    """Exact McNemar between prompt variants of a model on the correct flags."""
    p = variant_pairs(spark, sf)
    return I.mcnemar_exact(p, ["model", "a", "b"], "correct_a", "correct_b")


@register("chi2_association", views=("graded_t0",), doubles=("statistic", "p_value"), sql=f"""
WITH cells AS (SELECT model, a, b, x, y, count(*) AS n FROM ({VARIANT_PAIRS_SQL}) p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
{chi2_ctes('cells', ['model', 'a', 'b'], 'ch')}
SELECT * FROM ch""")
def chi2_association(spark, sf):
    """T3 (K3): Pearson chi-square on the crosstab of two variants' answers, zero shift 0.5."""
    cells = A.contingency(variant_pairs(spark, sf), ["model", "a", "b"])
    return I.chi2_association(cells, ["model", "a", "b"])


@register("stuart_maxwell", views=("graded_t0",), doubles=("statistic", "p_value"), sql=f"""
WITH RECURSIVE p AS ({VARIANT_PAIRS_SQL}),
c AS (SELECT model, a, b, x, y, CAST(count(*) AS DOUBLE) AS n FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
l AS (SELECT model, a, b, lab, row_number() OVER (PARTITION BY model, a, b ORDER BY lab) AS i, count(*) OVER (PARTITION BY model, a, b) AS k
      FROM (SELECT model, a, b, x AS lab FROM c UNION SELECT model, a, b, y FROM c) u),
d AS (SELECT l.model, l.a, l.b, l.i, l.k, (SELECT coalesce(sum(n), 0) FROM c WHERE c.model = l.model AND c.a = l.a AND c.b = l.b AND c.x = l.lab) AS r,
      (SELECT coalesce(sum(n), 0) FROM c WHERE c.model = l.model AND c.a = l.a AND c.b = l.b AND c.y = l.lab) AS q, l.lab FROM l),
e AS (SELECT f.model, f.a, f.b, f.i, g.i AS j, f.k, CASE WHEN f.i = g.i THEN f.r + f.q ELSE 0 END
      - coalesce((SELECT sum(n) FROM c WHERE c.model = f.model AND c.a = f.a AND c.b = f.b AND c.x = f.lab AND c.y = g.lab), 0)
      - coalesce((SELECT sum(n) FROM c WHERE c.model = f.model AND c.a = f.a AND c.b = f.b AND c.x = g.lab AND c.y = f.lab), 0) AS v
      FROM d f JOIN d g ON f.model = g.model AND f.a = g.a AND f.b = g.b WHERE f.i < f.k AND g.i < g.k),
z AS (SELECT model, a, b, i, j, k, v FROM e UNION ALL SELECT model, a, b, i, k, k, r - q FROM d WHERE i < k),
s(model, a, b, p, k, m, t) AS (
  SELECT model, a, b, 1, any_value(k), map_from_entries(list(row(i * 1000 + j, v))), CAST(0 AS DOUBLE) FROM z GROUP BY model, a, b
  UNION ALL SELECT model, a, b, p + 1, k, map_from_entries(list_transform(map_entries(m), lambda x: row(x.key, CASE WHEN x.key // 1000 <= p THEN x.value
      ELSE x.value - m[p * 1000 + x.key % 1000] * m[x.key // 1000 * 1000 + p] / m[p * 1000 + p] END))),
    t + m[p * 1000 + k] * m[p * 1000 + k] / m[p * 1000 + p] FROM s WHERE p < k)
SELECT model, a, b, t AS statistic, CAST(k - 1 AS INT) AS df, {chi2_sf_sql('t', '(k - 1)')} AS p_value FROM s WHERE p = k""")
def stuart_maxwell(spark, sf):
    """T4: Stuart-Maxwell marginal homogeneity between two variants (elimination by higher-order functions)."""
    cells = A.contingency(variant_pairs(spark, sf), ["model", "a", "b"])
    return I.stuart_maxwell(cells, ["model", "a", "b"])


_W_DOUBLES = ("w_pos", "w_neg", "statistic", "z", "p_value", "rank_biserial")
RATING_MODEL_PAIRS_SQL = f"""SELECT a.evaluator, a.metric, a.case_id, a.score AS x, b.score AS y FROM ratings a JOIN ratings b
  ON a.evaluator = b.evaluator AND a.metric = b.metric AND a.case_id = b.case_id WHERE a.model = '{MODEL_A}' AND b.model = '{MODEL_B}'"""


def rating_model_pairs(df, keys=("evaluator", "metric")):
    """Scores of the two compared models side by side, by one conditional aggregate."""
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("score")))
    return df.filter(F.col("model").isin(MODEL_A, MODEL_B)).groupBy(*keys, "case_id").agg(of(MODEL_A).alias("x"), of(MODEL_B).alias("y"))


@register("wilcoxon_signed_rank", views=("ratings",), doubles=_W_DOUBLES, tags=("bench",), sql=f"""
WITH pr AS ({RATING_MODEL_PAIRS_SQL}),
{wilcoxon_ctes('pr', ['evaluator', 'metric'], 'wx')}
SELECT * FROM wx""")
def wilcoxon_signed_rank(spark, sf):
    """Paired model comparison per (rater, metric): W+, W-, T, z, p, rank-biserial."""
    return I.wilcoxon_signed_rank(rating_model_pairs(fx.ratings(spark, sf)), ["evaluator", "metric"])


# exact null by trying all signs of the (doubled) ranks of a small group
_BLOCK_PAIRS_SQL = f"SELECT evaluator, metric, case_id // 8 AS block, x, y FROM ({RATING_MODEL_PAIRS_SQL}) p"
_SIGNS_SQL = f"""pr AS ({_BLOCK_PAIRS_SQL}),
{wilcoxon_ctes('pr', ['evaluator', 'metric', 'block'], 'wx')},
rk AS (SELECT evaluator, metric, block, CAST(2 * rank() OVER (PARTITION BY evaluator, metric, block ORDER BY abs(y - x))
         + count(*) OVER (PARTITION BY evaluator, metric, block, abs(y - x)) - 1 AS BIGINT) AS r FROM pr WHERE x <> y),
sg AS (SELECT evaluator, metric, block, list(r) AS rs FROM rk GROUP BY ALL),
ex AS (SELECT wx.*, CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * len(list_filter(list_transform(range(0, CAST(1 << n AS BIGINT)), lambda m:
         list_sum(list_transform(range(1, n + 1), lambda i: ((m >> CAST(i - 1 AS INT)) & 1) * rs[i]))), lambda w: w <= 2 * statistic)) / power(2.0, n)) END AS p_exact
       FROM wx LEFT JOIN sg USING (evaluator, metric, block))"""
_BLOCK_COLUMNS = "evaluator, metric, block, n_pairs, n, statistic"


def _block_pairs(spark, sf):
    x = fx.ratings(spark, sf).withColumn("block", F.expr("case_id div 8"))
    return rating_model_pairs(x, ("evaluator", "metric", "block"))


@register("wilcoxon_small_groups", views=("ratings",), doubles=("statistic", "p_value"), sql=f"""
WITH {_SIGNS_SQL} SELECT {_BLOCK_COLUMNS}, CASE WHEN method = 'exact' THEN p_exact ELSE p_value END AS p_value, method FROM ex""")
def wilcoxon_small_groups(spark, sf):
    """T5: the test within blocks of eight cases, exact where there are neither ties nor zeros, else by the normal approximation."""
    out = I.wilcoxon_signed_rank(_block_pairs(spark, sf), ["evaluator", "metric", "block"], method="auto")
    return out.select("evaluator", "metric", "block", "n_pairs", "n", "statistic", "p_value", "method")


@register("wilcoxon_exact", views=("ratings",), doubles=("statistic", "p_value", "rank_biserial"), sql=f"""
WITH {_SIGNS_SQL} SELECT {_BLOCK_COLUMNS}, p_exact AS p_value, 'exact' AS method, rank_biserial FROM ex""")
def wilcoxon_exact(spark, sf):
    """T5: the exact null, over the signs of average ranks, within blocks of eight cases."""
    out = I.wilcoxon_signed_rank(_block_pairs(spark, sf), ["evaluator", "metric", "block"], method="exact")
    return out.select("evaluator", "metric", "block", "n_pairs", "n", "statistic", "p_value", "method", "rank_biserial")


_PT_DOUBLES = ("median_a", "median_b", "median_difference", "mean_difference", "wilcoxon_statistic", "p_value_raw",
               "rank_biserial", "p_value_fdr_bh", "neg_log10_p_adj", "median_difference_95ci_low", "median_difference_95ci_high")


def _paired_sql(analysis_sql: str, keys: list[str], min_pairs: int, null_all_zero: bool) -> str:
    K = ", ".join(keys)
    p_expr = "CASE WHEN n = 0 THEN NULL ELSE p_value END" if null_all_zero else "p_value"
    s_expr = "CASE WHEN n = 0 THEN NULL ELSE statistic END" if null_all_zero else "statistic"
    return f"""WITH an AS ({analysis_sql}),
pr AS (SELECT {', '.join('a.' + k for k in keys)}, a.case_id, a.score AS x, b.score AS y FROM an a JOIN an b
       ON {' AND '.join(f'a.{k} = b.{k}' for k in keys)} AND a.case_id = b.case_id
       WHERE a.model = '{MODEL_A}' AND b.model = '{MODEL_B}' AND a.score IS NOT NULL AND b.score IS NOT NULL),
st AS (SELECT {K}, count(*) AS n_pairs, quantile_cont(x, 0.5) AS median_a, quantile_cont(y, 0.5) AS median_b,
       quantile_cont(y - x, 0.5) AS median_difference, avg(y - x) AS mean_difference FROM pr GROUP BY {K} HAVING count(*) >= {min_pairs}),
{wilcoxon_ctes('pr', keys, 'wx')},
res AS (SELECT st.*, {s_expr} AS wilcoxon_statistic, {p_expr} AS p_value_raw, wx.rank_biserial FROM st JOIN wx USING ({K})),
{bh_ctes('res', 'p_value_raw', 'bh', None, 0.05, 'p_value_fdr_bh', 'significant')}
SELECT bh.*, -log10(p_value_fdr_bh) AS neg_log10_p_adj, i.ci_low AS median_difference_95ci_low, i.ci_high AS median_difference_95ci_high
FROM bh JOIN ({median_diff_sql(analysis_sql, tuple(keys))}) i USING ({K})"""


def median_diff_interval(an, keys):
    """Bootstrap interval of the median paired difference (model B - model A) per key."""
    d = rating_model_pairs(an, keys).withColumn("d", F.col("y") - F.col("x"))
    return R.bootstrap_hist(d, list(keys), "d", B_MEDIAN, MEDIAN_SEED, stat="median")


def _paired_spark(an, keys, min_pairs: int, null_all_zero: bool):
    pr = rating_model_pairs(an, keys).where("x IS NOT NULL AND y IS NOT NULL")
    st = pr.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.percentile("x", 0.5).alias("median_a"), F.percentile("y", 0.5).alias("median_b"),
        F.percentile(F.col("y") - F.col("x"), 0.5).alias("median_difference"),
        F.avg(F.col("y") - F.col("x")).alias("mean_difference")).filter(F.col("n_pairs") >= min_pairs)
    wx = I.wilcoxon_signed_rank(pr, keys)
    stat = F.when(F.col("n") > 0, F.col("statistic")) if null_all_zero else F.col("statistic")
    pv = F.when(F.col("n") > 0, F.col("p_value")) if null_all_zero else F.col("p_value")
    res = st.join(wx.select(*keys, stat.alias("wilcoxon_statistic"), pv.alias("p_value_raw"), "rank_biserial"), list(keys))
    res = I.fdr_bh(res, "p_value_raw", out="p_value_fdr_bh", flag="significant")
    ci = median_diff_interval(an, keys).select(*keys, F.col("ci_low").alias("median_difference_95ci_low"), F.col("ci_high").alias("median_difference_95ci_high"))
    return res.withColumn("neg_log10_p_adj", -F.log10("p_value_fdr_bh")).join(ci, list(keys))


@register("paired_tests", views=("ratings",), doubles=_PT_DOUBLES,
          sql=_paired_sql(f"SELECT * FROM ({GATED_SQL}) g", ["evaluator", "metric"], 1, False))
def paired_tests(spark, sf):
    """Model B minus model A per (evaluator, metric) on the analysis data (gated average):
    medians, mean difference, Wilcoxon, rank-biserial, BH-adjusted p over all rows, -log10 p."""
    an = A.gated_average(fx.ratings(spark, sf), global_agreement_df(spark, sf))
    return _paired_spark(an, ["evaluator", "metric"], 1, False)


CORRECTNESS_SQL = f"""SELECT case_id, model, correct FROM graded_t0 WHERE variant = 'prompt1' AND model IN ('{MODEL_A}', '{MODEL_B}')"""
SCORES_CORR_SQL = f"""SELECT s.model, s.case_id, s.metric, s.score,
  CASE WHEN c.correct IS NULL THEN 'Unmatched' WHEN c.correct THEN 'Correct' ELSE 'Incorrect' END AS correctness_group
FROM (SELECT model, case_id, metric, avg(score) AS score FROM ratings GROUP BY ALL) s
LEFT JOIN ({CORRECTNESS_SQL}) c ON c.case_id = s.case_id AND c.model = s.model"""


def answers_correctness_df(spark, sf):
    g = graded_t0(spark, sf)
    return g.filter((F.col("variant") == "prompt1") & F.col("model").isin(MODEL_A, MODEL_B)).select("case_id", "model", "correct")


def scores_with_correctness_df(spark, sf, legacy: bool = False):
    s = A.rater_average(fx.ratings(spark, sf))
    # both sides grow with the cases: sizes estimated before the fan-out are far too small, and a broadcast would fill the driver
    c = answers_correctness_df(spark, sf).hint("merge")
    j = s.join(c, ["case_id", "model"], "left")
    unmatched = F.lit("Correct") if legacy else F.lit("Unmatched")  # K8: NULL was truthy in the reference
    grp = F.when(F.col("correct").isNull(), unmatched).when(F.col("correct"), "Correct").otherwise("Incorrect")
    return j.select("model", "case_id", "metric", "score", grp.alias("correctness_group"))


@register("answers_correctness", views=("graded_t0",), sql=CORRECTNESS_SQL)
def answers_correctness(spark, sf):
    """Per-case correctness of the two compared models (trimmed, upper-cased answers)."""
    return answers_correctness_df(spark, sf)


@register("scores_with_correctness", views=("graded_t0", "ratings"), doubles=("score",), sql=SCORES_CORR_SQL)
def scores_with_correctness(spark, sf):
    """J2/P19 (K8): rater-averaged scores left-joined to correctness; unmatched rows kept as their own group."""
    return scores_with_correctness_df(spark, sf)


@register("describe_by_correctness", views=("graded_t0", "ratings"),
          doubles=("mean", "sd", "median", "q1", "q3", "minimum", "maximum"), sql=f"""
SELECT model, metric, correctness_group, count(score) AS n, count_if(score IS NULL) AS missing, avg(score) AS mean, stddev_samp(score) AS sd,
  quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3, min(score) AS minimum, max(score) AS maximum
FROM ({SCORES_CORR_SQL}) s GROUP BY ALL""")
def describe_by_correctness(spark, sf):
    """Descriptive statistics by correctness group."""
    return S.describe(scores_with_correctness_df(spark, sf), ["model", "metric", "correctness_group"], "score")


@register("likert_percent_by_correctness", views=("graded_t0", "ratings"), doubles=("score", "percent"),
          sql=_likert_sql(f"({SCORES_CORR_SQL})", "correctness_group, model, metric"))
def likert_percent_by_correctness(spark, sf):
    """Percent of each averaged score per correctness group, model and metric; half points are levels of their own."""
    return S.likert_percent(scores_with_correctness_df(spark, sf), ["correctness_group", "model", "metric"])


@register("stratified_paired_tests", views=("graded_t0", "ratings"), doubles=_PT_DOUBLES,
          sql=_paired_sql(f"SELECT * FROM ({SCORES_CORR_SQL}) q WHERE correctness_group <> 'Unmatched'",
                          ["correctness_group", "metric"], 2, True))
def stratified_paired_tests(spark, sf):
    """Paired tests within correctness strata (both models in the stratum, >= 2 pairs), BH over non-NULL p."""
    an = scores_with_correctness_df(spark, sf).filter(F.col("correctness_group") != "Unmatched")
    return _paired_spark(an, ["correctness_group", "metric"], 2, True)


@register("t_interval_runs", views=("graded_rep",), doubles=("mean", "sd", "ci_low", "ci_high"), sql=f"""
SELECT temperature, model, avg(acc) AS mean, stddev_samp(acc) AS sd, count(acc) AS n,
       avg(acc) - {T_975_DF9!r} * stddev_samp(acc) / sqrt(CAST(count(acc) AS DOUBLE)) AS ci_low,
       avg(acc) + {T_975_DF9!r} * stddev_samp(acc) / sqrt(CAST(count(acc) AS DOUBLE)) AS ci_high
FROM (SELECT temperature, model, run, count_if(correct) / count(*) AS acc FROM graded_rep GROUP BY ALL) r GROUP BY ALL""")
def t_interval_runs(spark, sf):
    """T18 (K14): Student-t interval of per-run accuracy; t quantile for df = runs - 1 = 9."""
    runs = S.accuracy_by_run(graded_rep(spark, sf), REP_KEYS)
    return I.t_interval(runs, REP_KEYS, "acc", T_975_DF9)


@register("t0_vs_repeats", views=("graded_t0", "graded_rep"), doubles=("runs_mean",), sql="""
SELECT r.model, r.temperature, t.t0_correct, avg(r.n_correct) AS runs_mean, min(r.n_correct) AS runs_min, max(r.n_correct) AS runs_max
FROM (SELECT temperature, model, run, count_if(correct) AS n_correct FROM graded_rep GROUP BY ALL) r
JOIN (SELECT model, count_if(correct) AS t0_correct FROM graded_t0 WHERE variant = 'prompt1' GROUP BY ALL) t ON t.model = r.model
GROUP BY r.model, r.temperature, t.t0_correct""")
def t0_vs_repeats(spark, sf):
    """Single-run correct count next to the spread of per-run correct counts per temperature."""
    runs = S.accuracy_by_run(graded_rep(spark, sf), REP_KEYS)
    t0 = graded_t0(spark, sf).filter(F.col("variant") == "prompt1").groupBy("model").agg(F.count_if("correct").alias("t0_correct"))
    return (runs.join(t0, "model").groupBy("model", "temperature", "t0_correct")
            .agg(F.avg("n_correct").alias("runs_mean"), F.min("n_correct").alias("runs_min"), F.max("n_correct").alias("runs_max")))


_M1 = f"SELECT model, case_id, truth, valid, correct FROM graded_t0 WHERE variant = 'prompt1'"
_LO1, _HI1 = wilson_sql("correct_m1", "n")
_LO2, _HI2 = wilson_sql("correct_m2", "n")
_LOM, _HIM = wilson_sql("n_match", "n")
_SLO1, _SHI1 = wilson_sql("s.correct_m1", "s.n")
_SLO2, _SHI2 = wilson_sql("s.correct_m2", "s.n")
_SLOM, _SHIM = wilson_sql("s.n_match", "s.n")


@register("repro_pairs", views=("graded_t0", "graded_m2"), sql=f"""SELECT a.model, a.case_id, a.valid AS x, b.valid AS y,
  a.correct AS correct_a, b.correct AS correct_b FROM ({_M1}) a JOIN graded_m2 b ON a.model = b.model AND a.case_id = b.case_id""")
def repro_pairs_q(spark, sf):
    """Machine 1 and machine 2 answers of the same (model, case)."""
    return repro_pairs(spark, sf)


def repro_pairs(spark, sf):
    a = graded_t0(spark, sf).filter(F.col("variant") == "prompt1").select(
        "model", "case_id", F.col("valid").alias("x"), F.col("correct").alias("correct_a"))
    b = graded_m2(spark, sf).select("model", "case_id", F.col("valid").alias("y"), F.col("correct").alias("correct_b"))
    # neither side is small, whatever Spark estimates from the file before the fan-out: no broadcast through the driver
    return a.join(b.hint("merge"), ["model", "case_id"])


_REPRO_DOUBLES = ("acc_m1", "acc_m2", "ci_low_m1", "ci_high_m1", "ci_low_m2", "ci_high_m2", "match_rate",
                  "match_ci_low", "match_ci_high", "kappa", "mcnemar_p", "chi2_p")


@register("reproducibility_report", views=("graded_t0", "graded_m2"), doubles=_REPRO_DOUBLES, sql=f"""
WITH rp AS (SELECT a.model, a.case_id, a.valid AS x, b.valid AS y, a.correct AS correct_a, b.correct AS correct_b
            FROM ({_M1}) a JOIN graded_m2 b ON a.model = b.model AND a.case_id = b.case_id),
s AS (SELECT model, count(*) AS n, count_if(correct_a) AS correct_m1, count_if(correct_b) AS correct_m2, count_if(x = y) AS n_match,
             count_if(correct_a AND NOT correct_b) AS n_10, count_if(NOT correct_a AND correct_b) AS n_01 FROM rp GROUP BY model),
cells AS (SELECT model, x, y, count(*) AS n FROM rp WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
{kappa_ctes('cells', ['model'], None, 'kp')},
{chi2_ctes('cells', ['model'], 'ch')}
SELECT s.model, s.n, s.correct_m1, s.correct_m2, s.correct_m1 / s.n AS acc_m1, s.correct_m2 / s.n AS acc_m2,
       {_SLO1} AS ci_low_m1, {_SHI1} AS ci_high_m1, {_SLO2} AS ci_low_m2, {_SHI2} AS ci_high_m2,
       s.n_match, s.n_match / s.n AS match_rate, {_SLOM} AS match_ci_low, {_SHIM} AS match_ci_high,
       kp.kappa, {I.mcnemar_p_duckdb_sql('s.n_10', 's.n_01')} AS mcnemar_p, ch.p_value AS chi2_p
FROM s LEFT JOIN kp ON kp.model = s.model LEFT JOIN ch ON ch.model = s.model""")
def reproducibility_report(spark, sf):
    """T19 (K24): accuracy and Wilson CI on each machine, match rate, kappa, McNemar and chi-square across machines."""
    rp = repro_pairs(spark, sf)
    s = rp.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if("correct_a").alias("correct_m1"), F.count_if("correct_b").alias("correct_m2"),
        F.count_if(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("n_match"),
        F.count_if(F.col("correct_a") & ~F.col("correct_b")).alias("n_10"),
        F.count_if(~F.col("correct_a") & F.col("correct_b")).alias("n_01"))
    s = s.withColumns({
        "acc_m1": F.col("correct_m1") / F.col("n"), "acc_m2": F.col("correct_m2") / F.col("n"),
        "ci_low_m1": F.expr(_LO1), "ci_high_m1": F.expr(_HI1), "ci_low_m2": F.expr(_LO2), "ci_high_m2": F.expr(_HI2),
        "match_rate": F.col("n_match") / F.col("n"), "match_ci_low": F.expr(_LOM), "match_ci_high": F.expr(_HIM),
        "mcnemar_p": F.expr(I.mcnemar_p_spark_sql("n_10", "n_01"))})
    cells = A.contingency(rp, ["model"])
    kp = A.cohen_kappa(cells, ["model"]).select("model", "kappa")
    ch = I.chi2_association(cells, ["model"]).select("model", F.col("p_value").alias("chi2_p"))
    return s.join(kp, "model", "left").join(ch, "model", "left").drop("n_10", "n_01")
