"""Catalogue: grading, predicates and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import wilson_sql
from ..operators import grading as G
from ..operators import summary as S
from ..sources import fixtures as fx
from ..sources.tables import load_table
from .catalog import register
from .common import graded_t0

_LO, _HI = wilson_sql("n_correct", "n")
_ACC_DOUBLES = ("acc", "interpretable_rate", "ci_low", "ci_high", "lo_count", "hi_count")


def _accuracy_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, n_rows, n_correct, n_interpretable, n,
       n_correct / n AS acc, n_interpretable / n AS interpretable_rate,
       {_LO} AS ci_low, {_HI} AS ci_high, ({_LO}) * n AS lo_count, ({_HI}) * n AS hi_count
FROM (SELECT {keys}, count(*) AS n_rows, count_if(correct) AS n_correct, count_if(is_valid) AS n_interpretable,
             count(*) AS n FROM {src} GROUP BY {keys}) a"""


@register("accuracy_table", views=("graded_t0",), doubles=_ACC_DOUBLES, sql=_accuracy_sql("graded_t0", "model, variant"),
          tags=("flagship", "bench"))
def accuracy_table(spark, sf):
    """Correct / interpretable counts, rates and Wilson CI per (model, variant)."""
    return S.accuracy_table(graded_t0(spark, sf), ["model", "variant"])


@register("grade_responses", views=("graded_t0",),
          sql="SELECT case_id, model, variant, truth, response, category, valid, is_valid, correct FROM graded_t0")
def grade_responses(spark, sf):
    """P2 normalise, P5 category, P6 valid mask, P7 interpretable, P8 correct: the graded fact table."""
    return graded_t0(spark, sf).select("case_id", "model", "variant", "truth", "response", "category", "valid", "is_valid", "correct")


@register("ground_truth", views=("questions",), sql="""SELECT case_id,
       nullif(upper(substring(trim(answer), 1, 1)), '') AS truth, labs = 'Yes' AS labs, has_table = 'Yes' AS has_table
FROM questions""")
def ground_truth(spark, sf):
    """Truth letter (first letter of the answer) and Yes/No covariates as booleans."""
    return G.ground_truth(fx.questions(spark, sf))


@register("join_truth", views=("responses_t0", "questions"), sql="""SELECT r.case_id, r.model, r.variant, nullif(upper(trim(r.response)), '') AS response, g.truth,
       coalesce(CASE WHEN upper(trim(r.response)) IN ('A','B','C','D','E') THEN upper(trim(r.response)) END = g.truth, false) AS correct
FROM responses_t0 r JOIN (SELECT case_id, nullif(upper(substring(trim(answer), 1, 1)), '') AS truth FROM questions) g ON r.case_id = g.case_id""")
def join_truth(spark, sf):
    """Sheets without a key column joined to the question bank's truth letter on case_id."""
    r = fx.responses_t0(spark, sf).drop("truth", "labs")
    g = G.grade(r, G.ground_truth(fx.questions(spark, sf)))
    return g.select("case_id", "model", "variant", "response", "truth", "correct")


@register("exclude_cases", views=("graded_t0", "cases"), doubles=_ACC_DOUBLES, sql=_accuracy_sql(
    "(SELECT * FROM graded_t0 g WHERE g.case_id NOT IN (SELECT case_id FROM cases WHERE has_table))", "model, variant"))
def exclude_cases(spark, sf):
    """Drop listed cases (here: the table/figure cases) before scoring; anti join on case_id."""
    excluded = fx.cases(spark, sf).filter("has_table").select("case_id")
    return S.accuracy_table(G.exclude_cases(graded_t0(spark, sf), excluded), ["model", "variant"])


@register("except_cases", views=("cases",), sql="SELECT case_id FROM cases EXCEPT SELECT case_id FROM cases WHERE has_table")
def except_cases(spark, sf):
    """Complement of a case list (set difference)."""
    c = fx.cases(spark, sf)
    return c.select("case_id").exceptAll(c.filter("has_table").select("case_id")).distinct()


@register("filter_covariate", views=("graded_t0",), doubles=_ACC_DOUBLES,
          sql=_accuracy_sql("(SELECT * FROM graded_t0 WHERE labs)", "model, variant"))
def filter_covariate(spark, sf):
    """P10: accuracy restricted to a covariate (lab-value questions)."""
    return S.accuracy_table(graded_t0(spark, sf).filter("labs"), ["model", "variant"])


@register("completeness_check", views=("responses_t0",), sql="""
WITH a AS (SELECT * FROM responses_t0 WHERE response <> 'NONE'), u AS (SELECT DISTINCT l_orderkey AS case_id FROM lineitem)
SELECT g.model, g.variant, u.case_id, 'missing' AS problem FROM (SELECT DISTINCT model, variant FROM a) g CROSS JOIN u
WHERE NOT EXISTS (SELECT 1 FROM a r WHERE r.model = g.model AND r.variant = g.variant AND r.case_id = u.case_id)
UNION ALL
SELECT DISTINCT r.model, r.variant, r.case_id, 'unexpected' FROM a r WHERE r.case_id NOT IN (SELECT case_id FROM u)""")
def completeness_check(spark, sf):
    """Each sheet must hold an answer for every case of the case universe (orders with line items); list violations."""
    universe = load_table(spark, sf, "lineitem", ["l_orderkey"]).select(F.col("l_orderkey").alias("case_id")).distinct()
    answered = fx.responses_t0(spark, sf).where("response <> 'NONE'")
    return G.completeness_check(answered, universe, ["model", "variant"])


@register("correct_in_all_variants", views=("graded_t0",), sql="""SELECT model, case_id FROM graded_t0
GROUP BY model, case_id HAVING count_if(correct) = count(DISTINCT variant)""")
def correct_in_all_variants(spark, sf):
    """Cases answered correctly under every prompt variant of a model (set intersection)."""
    g = graded_t0(spark, sf)
    return (g.groupBy("model", "case_id")
            .agg(F.count_if("correct").alias("k"), F.count_distinct("variant").alias("v"))
            .filter(F.col("k") == F.col("v")).select("model", "case_id"))


@register("case_subset", views=("ratings", "cases"), sql="""SELECT r.* FROM ratings r
WHERE r.case_id IN (SELECT case_id FROM cases WHERE labs)""")
def case_subset(spark, sf):
    """Keep rating rows of a case subset (semi join)."""
    return fx.ratings(spark, sf).join(fx.cases(spark, sf).filter("labs").select("case_id"), "case_id", "left_semi")


@register("drop_empty_columns", views=("responses_rep",), sql="""SELECT case_id, model, temperature, run, response FROM responses_rep""")
def drop_empty_columns(spark, sf):
    """Drop sheet columns that are NULL everywhere (one ``count`` aggregate decides, then a select)."""
    from ..operators.reshape import drop_empty_columns as drop
    df = fx.responses_rep(spark, sf).withColumn("comment", F.lit(None).cast("string")).drop("truth")
    return drop(df)
