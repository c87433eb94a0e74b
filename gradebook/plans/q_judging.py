"""Catalogue: self-evaluation judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judging as J
from ..sources import fixtures as fx
from .catalog import register
from .common import graded_t0

_JOINED_SQL = """SELECT coalesce(w.model, g.model) AS model, coalesce(w.variant, g.variant) AS variant, coalesce(w.case_id, g.case_id) AS case_id, w.p1 = 1 AS preferred_1, w.p2 = 1 AS preferred_2, w.agreement_1, w.agreement_2, g.correct
FROM (SELECT model, variant, case_id,
        max(CASE WHEN truth_position = 1 THEN CAST(pt AS INT) END) AS p1, max(CASE WHEN truth_position = 2 THEN CAST(pt AS INT) END) AS p2,
        max(CASE WHEN truth_position = 1 THEN agreement END) AS agreement_1, max(CASE WHEN truth_position = 2 THEN agreement END) AS agreement_2
      FROM (SELECT *, CASE WHEN preferred = truth_position THEN true WHEN preferred = 3 - truth_position THEN false END AS pt FROM judgements) r
      GROUP BY model, variant, case_id) w
FULL JOIN (SELECT * FROM graded_t0 WHERE (model, variant) IN (SELECT DISTINCT model, variant FROM judgements)) g ON g.model = w.model AND g.variant = w.variant AND g.case_id = w.case_id"""
_FILTERED_SQL = f"""SELECT *, preferred_1 IS NOT NULL AND preferred_2 IS NOT NULL AS kept FROM ({_JOINED_SQL}) j WHERE NOT coalesce(correct, true)"""
_OUTCOME_SQL = """CASE WHEN NOT kept THEN 'hall_none' WHEN NOT preferred_1 AND NOT preferred_2 THEN 'never'
  WHEN NOT preferred_1 AND preferred_2 THEN 'second' WHEN preferred_1 AND NOT preferred_2 THEN 'first' ELSE 'both' END"""


def _filtered(spark, sf):
    return J.judge_filter(J.judge_joined(fx.judgements(spark, sf), graded_t0(spark, sf)))


@register("judge_recode", views=("judgements",), sql="""SELECT case_id, model, variant, truth_position, preferred, agreement,
  CASE WHEN preferred = truth_position THEN true WHEN preferred = 3 - truth_position THEN false END AS prefers_truth FROM judgements""")
def judge_recode(spark, sf):
    """Recode the preferred explanation to 'prefers the reference'."""
    return J.judge_recode(fx.judgements(spark, sf))


@register("judge_joined", views=("judgements", "graded_t0"), sql=_JOINED_SQL)
def judge_joined(spark, sf):
    """Both presentation orders aligned per case, with the model's correctness."""
    return J.judge_joined(fx.judgements(spark, sf), graded_t0(spark, sf))


@register("judge_filter", views=("judgements", "graded_t0"), sql=_FILTERED_SQL)
def judge_filter(spark, sf):
    """Wrong answers, with the both-orders-answered flag."""
    return _filtered(spark, sf)


@register("judge_outcomes", views=("judgements", "graded_t0"), doubles=("percent",), sql=f"""
WITH f AS ({_FILTERED_SQL}),
c AS (SELECT model, variant, {_OUTCOME_SQL} AS outcome, count(*) AS n FROM f GROUP BY ALL),
g AS (SELECT DISTINCT model, variant FROM f),
z AS (SELECT g.model, g.variant, o.outcome, CAST(coalesce(c.n, 0) AS BIGINT) AS n
      FROM g CROSS JOIN (SELECT unnest(['hall_none', 'never', 'second', 'first', 'both']) AS outcome) o
      LEFT JOIN c ON c.model = g.model AND c.variant = g.variant AND c.outcome = o.outcome)
SELECT model, variant, outcome, n, n * 100.0 / sum(n) OVER (PARTITION BY model, variant) AS percent FROM z""")
def judge_outcomes(spark, sf):
    """Outcome counts (hall/none, never, second, first, both) and percent."""
    return J.judge_outcomes(_filtered(spark, sf))


@register("judge_agreement_levels", views=("judgements", "graded_t0"), doubles=("mean", "median", "q1", "q3"), sql=f"""
WITH f AS ({_FILTERED_SQL}),
k AS (SELECT model, variant, {_OUTCOME_SQL} AS outcome,
        CASE WHEN agreement_1 IS NOT NULL AND agreement_2 IS NOT NULL THEN (agreement_1 + agreement_2) / 2.0
             WHEN agreement_1 IS NOT NULL THEN agreement_1 ELSE agreement_2 END AS level FROM f WHERE kept)
SELECT model, variant, outcome, count(level) AS n, avg(level) AS mean, quantile_cont(level, 0.5) AS median,
       quantile_cont(level, 0.25) AS q1, quantile_cont(level, 0.75) AS q3 FROM k GROUP BY ALL""")
def judge_agreement_levels(spark, sf):
    """Agreement level (mean of the two orders) per outcome."""
    return J.judge_agreement_levels(_filtered(spark, sf))
