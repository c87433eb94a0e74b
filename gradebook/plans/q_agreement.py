"""Catalogue: pairs, contingency, kappa family, ICC, rater agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import wilson_sql
from ..operators import agreement as A
from ..operators import summary as S
from ..sources import fixtures as fx
from .catalog import register
from .common import graded_t0
from .q_summary import _DESC_DOUBLES, _describe_sql
from .sqlkit import icc_ctes, kappa_ctes

VARIANT_PAIRS_SQL = """SELECT a.model, a.case_id, a.variant AS a, b.variant AS b, a.valid AS x, b.valid AS y,
       a.correct AS correct_a, b.correct AS correct_b, a.truth AS truth_a
FROM graded_t0 a JOIN graded_t0 b ON a.model = b.model AND a.case_id = b.case_id AND a.variant < b.variant"""

MODEL_PAIRS_SQL = """SELECT a.variant, a.case_id, a.model AS a, b.model AS b, a.valid AS x, b.valid AS y
FROM graded_t0 a JOIN graded_t0 b ON a.variant = b.variant AND a.case_id = b.case_id AND a.model < b.model"""

RATER_PAIRS_SQL = """SELECT a.model, a.metric, a.case_id, a.score AS y1, b.score AS y2
FROM ratings a JOIN ratings b ON a.model = b.model AND a.metric = b.metric AND a.case_id = b.case_id
WHERE a.evaluator = 'user1' AND b.evaluator = 'user2' AND a.score IS NOT NULL AND b.score IS NOT NULL"""


VARIANT_NAMES = sorted(v for _, v in fx.VARIANTS)
MODEL_NAMES = sorted(m for _, m in fx.MODELS)


def variant_pairs(spark, sf):
    return A.pairs(graded_t0(spark, sf), ["model", "case_id"], "variant", "valid", VARIANT_NAMES, extra=["correct", "truth"])


def model_pairs(spark, sf):
    return A.pairs(graded_t0(spark, sf), ["variant", "case_id"], "model", "valid", MODEL_NAMES)


@register("variant_pairs", views=("graded_t0",), sql=f"SELECT model, case_id, a, b, x, y FROM ({VARIANT_PAIRS_SQL}) p")
def variant_pairs_q(spark, sf):
    """Every unordered pair of prompt variants of a model, aligned on the case."""
    return variant_pairs(spark, sf).select("model", "case_id", "a", "b", "x", "y")


@register("contingency", views=("graded_t0",), sql=f"""SELECT model, a, b, x, y, count(*) AS n FROM ({VARIANT_PAIRS_SQL}) p
WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def contingency(spark, sf):
    """Crosstab cells of valid answers under two variants."""
    return A.contingency(variant_pairs(spark, sf), ["model", "a", "b"])


_LO, _HI = wilson_sql("n_agreements", "n_cases")


@register("prompt_agreement", views=("graded_t0",), doubles=("match_rate", "fixed_kappa", "ci_low", "ci_high"), sql=f"""
SELECT model, a, b, n_cases, n_agreements, n_match_correct, n_agreements / n_cases AS match_rate,
       (n_agreements / n_cases - 0.2) / 0.8 AS fixed_kappa, {_LO} AS ci_low, {_HI} AS ci_high
FROM (SELECT model, a, b, count(*) AS n_cases, count_if(x = y) AS n_agreements, count_if(x = y AND x = truth_a) AS n_match_correct
      FROM ({VARIANT_PAIRS_SQL}) p GROUP BY ALL) s""")
def prompt_agreement(spark, sf):
    """Agreement count, match-and-correct, match rate with Wilson CI, fixed-chance kappa (K2)."""
    p = variant_pairs(spark, sf)
    agree = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    s = p.groupBy("model", "a", "b").agg(
        F.count("*").alias("n_cases"), F.count_if(agree).alias("n_agreements"),
        F.count_if(agree & (F.col("x") == F.col("truth_a"))).alias("n_match_correct"))
    return s.withColumns({
        "match_rate": F.col("n_agreements") / F.col("n_cases"),
        "fixed_kappa": (F.col("n_agreements") / F.col("n_cases") - F.lit(0.2)) / F.lit(0.8),
        "ci_low": F.expr(_LO), "ci_high": F.expr(_HI)})


@register("fixed_chance_kappa", views=("graded_t0",), doubles=("fixed_kappa",), sql=f"""
SELECT model, a, b, (count_if(x = y) / count(*) - 0.2) / 0.8 AS fixed_kappa FROM ({VARIANT_PAIRS_SQL}) p GROUP BY ALL""")
def fixed_chance_kappa(spark, sf):
    """(match rate - 1/5) / (1 - 1/5), denominator = all cases."""
    p = variant_pairs(spark, sf)
    return p.groupBy("model", "a", "b").agg(
        ((F.count_if(F.coalesce(F.col("x") == F.col("y"), F.lit(False))) / F.count("*") - F.lit(0.2)) / F.lit(0.8)).alias("fixed_kappa"))


@register("kappa_matrix", views=("graded_t0",), doubles=("kappa",), tags=("bench",), sql=f"""
WITH mp AS ({MODEL_PAIRS_SQL}),
cells AS (SELECT variant, a, b, x, y, count(*) AS n FROM mp WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
{kappa_ctes('cells', ['variant', 'a', 'b'], None, 'kp')}
SELECT variant, a AS model_a, b AS model_b, n, kappa FROM kp
UNION ALL SELECT variant, b, a, n, kappa FROM kp
UNION ALL SELECT variant, model, model, count(*), 1.0 FROM graded_t0 WHERE valid IS NOT NULL GROUP BY ALL""")
def kappa_matrix(spark, sf):
    """A19 (K11): Cohen's kappa for every model pair within a variant, mirrored, diagonal 1."""
    wide = A.side_by_side(graded_t0(spark, sf), ["variant", "case_id"], "model", MODEL_NAMES, ["valid"])
    made = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}")["valid"].alias("x"), F.col(f"_{j}")["valid"].alias("y"))
            for i, a in enumerate(MODEL_NAMES) for j, b in enumerate(MODEL_NAMES) if i <= j]
    cells = A.contingency(wide.select("variant", F.explode(F.array(*made)).alias("p")).select("variant", "p.*"), ["variant", "a", "b"])
    # pairs of a model with itself come along as the diagonal: kappa 1 whatever the answers
    kp = A.cohen_kappa(cells, ["variant", "a", "b"]).withColumn("kappa", F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("kappa")))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("model_a"), F.col("b").alias("model_b")))).otherwise(F.array(
        F.struct(F.col("a").alias("model_a"), F.col("b").alias("model_b")), F.struct(F.col("b").alias("model_a"), F.col("a").alias("model_b"))))
    return kp.select("variant", F.explode(both).alias("m"), "n", "kappa").select("variant", "m.*", "n", "kappa")


def rater_pairs(spark, sf):
    return A.rater_pairs(fx.ratings(spark, sf))


@register("rater_agreement", views=("ratings",), doubles=("exact_agreement", "mean_abs_difference"), sql=f"""
SELECT model, metric, count(*) AS n, avg(CAST(y1 = y2 AS DOUBLE)) AS exact_agreement, avg(abs(y1 - y2)) AS mean_abs_difference
FROM ({RATER_PAIRS_SQL}) rp GROUP BY ALL""")
def rater_agreement(spark, sf):
    """Exact agreement and mean absolute difference between the two raters."""
    return A.rater_agreement(rater_pairs(spark, sf), ["model", "metric"])


@register("weighted_kappa", views=("ratings",), doubles=("quadratic_weighted_kappa", "linear_weighted_kappa"), sql=f"""
WITH rp AS ({RATER_PAIRS_SQL}),
cells AS (SELECT model, metric, y1 AS x, y2 AS y, count(*) AS n FROM rp GROUP BY ALL),
{kappa_ctes('cells', ['model', 'metric'], 'quadratic', 'kq')},
{kappa_ctes('cells', ['model', 'metric'], 'linear', 'kl')}
SELECT kq.model, kq.metric, kq.n, kq.kappa AS quadratic_weighted_kappa, kl.kappa AS linear_weighted_kappa
FROM kq JOIN kl ON kq.model = kl.model AND kq.metric = kl.metric""")
def weighted_kappa(spark, sf):
    """Linear and quadratic weighted kappa on the label index."""
    a = A.rater_cells(rater_pairs(spark, sf), ["model", "metric"])
    a = A.with_kappa(A.with_kappa(a, "quadratic", "quadratic_weighted_kappa"), "linear", "linear_weighted_kappa")
    return a.select("model", "metric", F.expr("aggregate(cs, 0L, (acc, c) -> acc + c.n)").alias("n"), "quadratic_weighted_kappa", "linear_weighted_kappa")


@register("icc", views=("ratings",), doubles=("icc2_1", "icc2_k"), sql=f"""
WITH rp AS ({RATER_PAIRS_SQL}),
lg AS (SELECT model, metric, case_id AS target, 'user1' AS rater, y1 AS v FROM rp UNION ALL SELECT model, metric, case_id, 'user2', y2 FROM rp),
{icc_ctes('lg', ['model', 'metric'], 'ic')}
SELECT * FROM ic""")
def icc(spark, sf):
    """ICC(2,1) and ICC(2,k) per (model, metric)."""
    a = A.with_icc_of_two(A.rater_cells(rater_pairs(spark, sf), ["model", "metric"]))
    return a.select("model", "metric", F.expr("aggregate(cs, 0L, (acc, c) -> acc + c.n)").alias("n"), F.lit(2).cast("bigint").alias("k"), "icc2_1", "icc2_k")


_GLOBAL_DOUBLES = ("exact_agreement", "mean_abs_difference", "quadratic_weighted_kappa", "linear_weighted_kappa",
                   "icc2_1_single_rater", "icc2_k_average_raters")
GLOBAL_SQL = f"""WITH rp AS ({RATER_PAIRS_SQL}),
cells AS (SELECT model, y1 AS x, y2 AS y, count(*) AS n FROM rp GROUP BY ALL),
{kappa_ctes('cells', ['model'], 'quadratic', 'kq')},
{kappa_ctes('cells', ['model'], 'linear', 'kl')},
lg AS (SELECT model, CAST(case_id AS VARCHAR) || '|' || metric AS target, 'user1' AS rater, y1 AS v FROM rp
       UNION ALL SELECT model, CAST(case_id AS VARCHAR) || '|' || metric, 'user2', y2 FROM rp),
{icc_ctes('lg', ['model'], 'ic')},
ra AS (SELECT model, count(*) AS n, avg(CAST(y1 = y2 AS DOUBLE)) AS exact_agreement, avg(abs(y1 - y2)) AS mean_abs_difference FROM rp GROUP BY ALL)
SELECT ra.model, ra.n AS n_pooled_ratings, ra.exact_agreement, ra.mean_abs_difference, kq.kappa AS quadratic_weighted_kappa,
       kl.kappa AS linear_weighted_kappa, ic.icc2_1 AS icc2_1_single_rater, ic.icc2_k AS icc2_k_average_raters,
       kq.kappa >= 0.75 AS meets_averaging_threshold
FROM ra JOIN kq ON ra.model = kq.model JOIN kl ON ra.model = kl.model LEFT JOIN ic ON ra.model = ic.model"""


def global_agreement_df(spark, sf):
    t = A.agreement_table(rater_pairs(spark, sf), ["model"])
    return t.select("model", F.col("n").alias("n_pooled_ratings"), "exact_agreement", "mean_abs_difference",
                    "quadratic_weighted_kappa", "linear_weighted_kappa", "icc2_1_single_rater", "icc2_k_average_raters",
                    (F.col("quadratic_weighted_kappa") >= 0.75).alias("meets_averaging_threshold"))


@register("global_agreement", views=("ratings",), doubles=_GLOBAL_DOUBLES, sql=GLOBAL_SQL)
def global_agreement(spark, sf):
    """Agreement pooled over the five metrics per model, with the averaging threshold flag."""
    return global_agreement_df(spark, sf)


GATED_SQL = f"""WITH ga AS ({GLOBAL_SQL.replace('WITH rp AS', 'SELECT * FROM (WITH rp AS', 1)}) g),
gate AS (SELECT bool_and(meets_averaging_threshold) AS can_average FROM ga)
SELECT model, case_id, metric, 'average_user1_user2' AS evaluator, avg(score) AS score FROM ratings
WHERE (SELECT can_average FROM gate) GROUP BY model, case_id, metric
UNION ALL SELECT model, case_id, metric, evaluator, score FROM ratings WHERE NOT (SELECT can_average FROM gate)"""


@register("gated_average", views=("ratings",), doubles=("score",), sql=GATED_SQL)
def gated_average(spark, sf):
    """Average the raters only if every model reaches the pooled-kappa threshold."""
    return A.gated_average(fx.ratings(spark, sf), global_agreement_df(spark, sf))


@register("agreement_levels", views=("ratings",), doubles=("exact_agreement", "mean_abs_difference", "quadratic_weighted_kappa", "linear_weighted_kappa"), sql=f"""
WITH rp AS (SELECT model, metric, y1, y2, false AS is_pooled FROM ({RATER_PAIRS_SQL}) a UNION ALL SELECT model, NULL, y1, y2, true FROM ({RATER_PAIRS_SQL}) b),
ky AS (SELECT model, coalesce(metric, '') AS metric, is_pooled, y1, y2 FROM rp),
cells AS (SELECT model, metric, is_pooled, y1 AS x, y2 AS y, count(*) AS n FROM ky GROUP BY ALL),
{kappa_ctes('cells', ['model', 'metric', 'is_pooled'], 'quadratic', 'kq')},
{kappa_ctes('cells', ['model', 'metric', 'is_pooled'], 'linear', 'kl')},
ra AS (SELECT model, metric, is_pooled, count(*) AS n, avg(CAST(y1 = y2 AS DOUBLE)) AS exact_agreement, avg(abs(y1 - y2)) AS mean_abs_difference FROM ky GROUP BY ALL)
SELECT ra.model, nullif(ra.metric, '') AS metric, ra.is_pooled, ra.n, exact_agreement, mean_abs_difference, kq.kappa AS quadratic_weighted_kappa, kl.kappa AS linear_weighted_kappa
FROM ra JOIN kq USING (model, metric, is_pooled) JOIN kl USING (model, metric, is_pooled)""")
def agreement_levels(spark, sf):
    """A22 and A23 in one pass: agreement by (model, metric) and pooled over the metrics of a model."""
    t = A.agreement_levels(rater_pairs(spark, sf), ["model", "metric"], ["model"])
    return t.select("model", "metric", "is_pooled", "n", "exact_agreement", "mean_abs_difference", "quadratic_weighted_kappa", "linear_weighted_kappa")


@register("describe_analysis", views=("ratings",), doubles=_DESC_DOUBLES, sql=_describe_sql(f"({GATED_SQL})", "evaluator, model, metric"))
def describe_analysis(spark, sf):
    """Statistics of the analysis scores per (evaluator, model, metric): averaged over raters where the gate allows it,
    else each rater's own."""
    an = A.gated_average(fx.ratings(spark, sf), global_agreement_df(spark, sf))
    return S.describe(an, ["evaluator", "model", "metric"], "score")
