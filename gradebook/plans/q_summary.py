"""Catalogue: group summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import summary as S
from ..sources import fixtures as fx
from ..sources.tables import load_table
from .catalog import register
from .common import REP_KEYS, TEMPS, graded_rep, graded_t0, per_case_rep, votes_rep

_DIST_SQL = """SELECT {keys},
  count_if(category = 'CHECK') AS n_check, count_if(category = 'MULTI') AS n_multi, count_if(category = 'HALL / NONE') AS n_hall_none,
  count_if(category = 'A') AS n_a, count_if(category = 'B') AS n_b, count_if(category = 'C') AS n_c,
  count_if(category = 'D') AS n_d, count_if(category = 'E') AS n_e,
  count_if(category NOT IN ('CHECK', 'MULTI', 'HALL / NONE', 'A', 'B', 'C', 'D', 'E')) AS n_other,
  count_if(category IS NULL) AS n_missing, count(category) AS total
FROM {src} GROUP BY {keys}"""


@register("response_distribution", views=("graded_t0",), sql=_DIST_SQL.format(keys="model, variant", src="graded_t0"))
def response_distribution(spark, sf):
    """A1: zero-filled label distribution per single-run sheet."""
    return S.response_distribution(graded_t0(spark, sf), ["model", "variant"])


@register("response_distribution_rep", views=("graded_rep",), sql=_DIST_SQL.format(keys="temperature, model", src="graded_rep"),
          tags=("bench",))
def response_distribution_rep(spark, sf):
    """A1 over the repeat sheets (all runs of a temperature/model)."""
    return S.response_distribution(graded_rep(spark, sf), REP_KEYS)


@register("accuracy_by_run", views=("graded_rep",), doubles=("acc",), sql="""SELECT temperature, model, run,
  count_if(correct) AS n_correct, count(*) AS n, count_if(correct) / count(*) AS acc FROM graded_rep GROUP BY ALL""")
def accuracy_by_run(spark, sf):
    """A3: correct per run."""
    return S.accuracy_by_run(graded_rep(spark, sf), REP_KEYS)


@register("correct_per_case", views=("per_case_rep",), sql="SELECT * FROM per_case_rep")
def correct_per_case(spark, sf):
    """A4: correct runs per (temperature, model, case)."""
    return per_case_rep(spark, sf)


@register("plurality_vote", views=("votes_rep",), tags=("bench",),
          sql="SELECT temperature, model, case_id, n_answers, tie, vote, n_vote FROM votes_rep")
def plurality_vote(spark, sf):
    """A5: plurality vote over the runs; tie -> NULL vote and NULL count (identify_majority)."""
    return votes_rep(spark, sf)


@register("plurality_vote_count_max", views=("votes_rep",),
          sql="SELECT temperature, model, case_id, n_answers, tie, vote, top_n AS n_vote FROM votes_rep")
def plurality_vote_count_max(spark, sf):
    """A5 with identify_majority=False: ties keep the top count."""
    return votes_rep(spark, sf, identify_majority=False)


@register("vote_frequency", views=("votes_rep",), sql="""SELECT temperature, model, coalesce(vote, 'TIE') AS vote_label, count(*) AS n
FROM votes_rep GROUP BY ALL""")
def vote_frequency(spark, sf):
    """How often each label is the plurality vote per (temperature, model)."""
    return S.vote_frequency(votes_rep(spark, sf), REP_KEYS)


@register("consistency", views=("votes_rep",), doubles=("mean_consistency",), tags=("bench",),
          sql="""SELECT temperature, model, avg(CAST(top_n AS DOUBLE) / 10) AS mean_consistency, count(*) AS n_cases
FROM votes_rep GROUP BY ALL""")
def consistency(spark, sf):
    """Mean per-case consistency (top label count / 10 runs)."""
    per_case = S.consistency(graded_rep(spark, sf), REP_KEYS)
    return S.mean_consistency(per_case, REP_KEYS)


@register("correct_count_histogram", views=("per_case_rep",), sql="""SELECT g.temperature, g.model, CAST(k.k AS INT) AS n_correct,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT temperature, model FROM per_case_rep) g CROSS JOIN range(0, 11) k(k)
LEFT JOIN (SELECT temperature, model, n_correct, count(*) AS n FROM per_case_rep GROUP BY ALL) c
  ON c.temperature = g.temperature AND c.model = g.model AND c.n_correct = k.k""")
def correct_count_histogram(spark, sf):
    """Distribution of correct counts 0..10, zero-filled."""
    return S.correct_count_histogram(per_case_rep(spark, sf), REP_KEYS)


@register("never_correct", views=("per_case_rep",), sql="""SELECT temperature, model, count_if(n_correct = 0) AS n_never_correct
FROM per_case_rep GROUP BY ALL""")
def never_correct(spark, sf):
    """A9."""
    return S.never_correct(per_case_rep(spark, sf), REP_KEYS)


@register("always_correct_or_wrong", views=("per_case_rep", "votes_rep"), sql="""SELECT p.temperature, p.model,
  count_if(p.n_correct = 10) AS n_correct_all, count_if(v.n_vote = 10) - count_if(p.n_correct = 10) AS n_consistently_wrong
FROM per_case_rep p LEFT JOIN votes_rep v USING (temperature, model, case_id) GROUP BY ALL""")
def always_correct_or_wrong(spark, sf):
    """A10: correct in all runs vs. same wrong answer in all runs."""
    return S.always_correct_or_wrong(S.case_summary(graded_rep(spark, sf), REP_KEYS), REP_KEYS)


@register("dominance", views=("per_case_rep",), sql="""SELECT p.temperature, p.model, count_if(p.n_correct >= b.best) AS best_or_tied_cases
FROM per_case_rep p JOIN (SELECT temperature, case_id, max(n_correct) AS best FROM per_case_rep GROUP BY ALL) b
USING (temperature, case_id) GROUP BY ALL""")
def dominance(spark, sf):
    """Per (temperature, model) cases where the model is best or tied among models."""
    return S.dominance(per_case_rep(spark, sf), ["temperature"])


_TPAIRS = [(1, 0), (2, 0), (2, 1), (0, 2)]


def _temp_cmp_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT model, CAST({TEMPS[a]} AS DOUBLE) AS t_a, CAST({TEMPS[b]} AS DOUBLE) AS t_b, count_if(v{a} > v{b}) AS n_cases_a_gt_b FROM w GROUP BY model"
        for a, b in _TPAIRS)
    return f"""WITH w AS (SELECT model, case_id,
  max(CASE WHEN temperature = {TEMPS[0]} THEN n_correct END) AS v0,
  max(CASE WHEN temperature = {TEMPS[1]} THEN n_correct END) AS v1,
  max(CASE WHEN temperature = {TEMPS[2]} THEN n_correct END) AS v2
FROM per_case_rep GROUP BY model, case_id)
{rows}"""


@register("temperature_comparison", views=("per_case_rep",), doubles=("t_a", "t_b"), sql=_temp_cmp_sql())
def temperature_comparison(spark, sf):
    """Cases where temperature a gives more correct runs than temperature b, per model."""
    return S.temperature_comparison(per_case_rep(spark, sf), TEMPS, _TPAIRS)


@register("superiority_vs_set", views=("per_case_rep",), sql="""SELECT temperature, count_if(mine >= theirs) AS n_cases, 'm0' AS model
FROM (SELECT temperature, case_id, max(CASE WHEN model = 'm0' THEN n_correct END) AS mine,
             max(CASE WHEN model <> 'm0' THEN n_correct END) AS theirs
      FROM per_case_rep WHERE model IN ('m0', 'm1', 'm2', 'm3') GROUP BY ALL) x GROUP BY temperature""")
def superiority_vs_set(spark, sf):
    """Cases where a chosen model's correct count is >= every model of a set."""
    return S.superiority_vs_set(per_case_rep(spark, sf), ["temperature"], "m0", ["m1", "m2", "m3"])


@register("first_best_temperature", views=("per_case_rep",), sql=f"""SELECT model, count_if(v0 >= greatest(v1, v2)) AS n_first_best
FROM (SELECT model, case_id,
  max(CASE WHEN temperature = {TEMPS[0]} THEN n_correct END) AS v0,
  max(CASE WHEN temperature = {TEMPS[1]} THEN n_correct END) AS v1,
  max(CASE WHEN temperature = {TEMPS[2]} THEN n_correct END) AS v2
FROM per_case_rep GROUP BY model, case_id) w GROUP BY model""")
def first_best_temperature(spark, sf):
    """Cases where the first temperature is the (first) best."""
    return S.first_best_level(per_case_rep(spark, sf), ["model"], "temperature", TEMPS)


@register("consistency_correctness_heatmap", views=("per_case_rep", "votes_rep"), sql="""
WITH cells AS (SELECT v.temperature, v.model, CAST(CASE WHEN v.n_vote >= 8 THEN v.n_vote ELSE 7 END AS INT) AS bucket, p.n_correct, count(*) AS n
               FROM votes_rep v JOIN per_case_rep p USING (temperature, model, case_id) WHERE NOT v.tie GROUP BY ALL),
grid AS (SELECT g.temperature, g.model, CAST(b.b AS INT) AS bucket, CAST(k.k AS INT) AS n_correct
         FROM (SELECT DISTINCT temperature, model FROM votes_rep) g CROSS JOIN range(7, 11) b(b) CROSS JOIN range(0, 11) k(k))
SELECT grid.temperature, grid.model, grid.bucket,
       CASE WHEN grid.bucket = 7 THEN '<=0.7' ELSE printf('%.1f', grid.bucket / 10.0) END AS bucket_label,
       grid.n_correct, CAST(coalesce(cells.n, 0) AS BIGINT) AS n
FROM grid LEFT JOIN cells USING (temperature, model, bucket, n_correct)""")
def consistency_correctness_heatmap(spark, sf):
    """Majority-count bucket x correct-count cells, zero-filled."""
    return S.consistency_correctness_heatmap(S.case_summary(graded_rep(spark, sf), REP_KEYS), REP_KEYS)


_DESC_DOUBLES = ("mean", "sd", "median", "q1", "q3", "minimum", "maximum")


def _describe_sql(src: str, keys: str, value: str = "score") -> str:
    return f"""SELECT {keys}, count({value}) AS n, count_if({value} IS NULL) AS missing, avg({value}) AS mean,
  stddev_samp({value}) AS sd, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.25) AS q1,
  quantile_cont({value}, 0.75) AS q3, min({value}) AS minimum, max({value}) AS maximum
FROM {src} GROUP BY {keys}"""


@register("describe_by_file", views=("ratings",), doubles=_DESC_DOUBLES,
          sql=_describe_sql("(SELECT *, model || '_' || evaluator || '.xlsx' AS source_file FROM ratings)", "source_file, model, evaluator, metric"))
def describe_by_file(spark, sf):
    """Descriptive statistics per rating sheet and metric."""
    r = fx.ratings(spark, sf).withColumn("source_file", F.concat(F.col("model"), F.lit("_"), F.col("evaluator"), F.lit(".xlsx")))
    return S.describe(r, ["source_file", "model", "evaluator", "metric"], "score")


@register("describe_runs", views=("graded_rep",), doubles=_DESC_DOUBLES,
          sql=_describe_sql("(SELECT temperature, model, run, CAST(count_if(correct) AS DOUBLE) / count(*) AS acc FROM graded_rep GROUP BY ALL)",
                            "temperature, model", "acc"))
def describe_runs(spark, sf):
    """Statistics of per-run accuracy over the runs of a (temperature, model)."""
    return S.describe(S.accuracy_by_run(graded_rep(spark, sf), REP_KEYS), REP_KEYS, "acc")


@register("group_sizes", views=("ratings",), sql="SELECT model, evaluator, count(*) AS n_rows FROM ratings GROUP BY ALL")
def group_sizes(spark, sf):
    """Rows per rating sheet."""
    return S.group_sizes(fx.ratings(spark, sf), ["model", "evaluator"])


def _likert_sql(src: str, keys: str) -> str:
    on = " AND ".join(f"c.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    ks = ", ".join(f"coalesce(g.{k.strip()}, c.{k.strip()}) AS {k.strip()}" for k in keys.split(","))
    return f"""WITH c AS (SELECT {keys}, score, count(*) AS n FROM {src} s WHERE score IS NOT NULL GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT {keys} FROM c) k CROSS JOIN (SELECT CAST(i AS DOUBLE) AS level FROM range(1, 6) s(i)) l),
z AS (SELECT {ks}, coalesce(g.level, c.score) AS score, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g FULL JOIN c ON {on} AND c.score = g.level)
SELECT {keys}, score, n, n * 100.0 / sum(n) OVER (PARTITION BY {keys}) AS percent FROM z"""


@register("likert_percent", views=("ratings",), doubles=("score", "percent"), sql=_likert_sql("ratings", "model, metric"))
def likert_percent(spark, sf):
    """Percent of each Likert level per (model, metric), zero-filled."""
    return S.likert_percent(fx.ratings(spark, sf), ["model", "metric"])


@register("median_iqr", views=("ratings",), doubles=("median", "q1", "q3", "iqr"), sql="""SELECT model, metric,
  quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3, count(score) AS n,
  quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM ratings GROUP BY ALL""")
def median_iqr(spark, sf):
    """A30."""
    return S.median_iqr(fx.ratings(spark, sf), ["model", "metric"], "score")


@register("box_stats", views=("per_case_rep",), doubles=("median", "q1", "q3", "iqr", "whisker_low", "whisker_high"), sql="""
WITH q AS (SELECT temperature, model, quantile_cont(n_correct, 0.5) AS median, quantile_cont(n_correct, 0.25) AS q1,
                  quantile_cont(n_correct, 0.75) AS q3, count(n_correct) AS n,
                  quantile_cont(n_correct, 0.75) - quantile_cont(n_correct, 0.25) AS iqr FROM per_case_rep GROUP BY ALL)
SELECT q.*, w.whisker_low, w.whisker_high, w.n_outliers FROM q LEFT JOIN (
  SELECT p.temperature, p.model,
    min(CASE WHEN p.n_correct >= q.q1 - 1.5 * q.iqr THEN CAST(p.n_correct AS DOUBLE) END) AS whisker_low,
    max(CASE WHEN p.n_correct <= q.q3 + 1.5 * q.iqr THEN CAST(p.n_correct AS DOUBLE) END) AS whisker_high,
    count_if(p.n_correct < q.q1 - 1.5 * q.iqr OR p.n_correct > q.q3 + 1.5 * q.iqr) AS n_outliers
  FROM per_case_rep p JOIN q USING (temperature, model) GROUP BY ALL) w USING (temperature, model)""")
def box_stats(spark, sf):
    """Box-plot numbers of correct counts per (temperature, model)."""
    return S.box_stats(per_case_rep(spark, sf), REP_KEYS, "n_correct")


_BY_STATUS = "SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders"


@register("describe_continuous", views=(), doubles=_DESC_DOUBLES, sql=_describe_sql(f"({_BY_STATUS})", "o_orderpriority", "o_totalprice"))
def describe_continuous(spark, sf):
    """A25/A30 on a value with as many levels as rows: exact percentiles by distributed selection."""
    return S.describe_continuous(load_table(spark, sf, "orders", ["o_orderpriority", "o_totalprice"]), ["o_orderpriority"], "o_totalprice")


@register("totals_check", views=("per_case_rep",), sql="""SELECT temperature, model, CAST(sum(n) AS BIGINT) AS total, CAST(any_value(n_cases) AS BIGINT) AS n_cases, sum(n) = any_value(n_cases) AS agrees
FROM (SELECT temperature, model, n_correct, count(*) AS n, (SELECT count(*) FROM orders) AS n_cases FROM per_case_rep GROUP BY ALL) h GROUP BY ALL""")
def totals_check(spark, sf):
    """The counts of A8 must add up to the number of cases in each group."""
    h = S.correct_count_histogram(per_case_rep(spark, sf), REP_KEYS)
    n = load_table(spark, sf, "orders", ["o_orderkey"]).agg(F.count("*")).scalar()
    return h.groupBy(*REP_KEYS).agg(F.sum("n").alias("total")).withColumn("n_cases", n).withColumn("agrees", F.col("total") == F.col("n_cases"))


@register("accuracy_ordered", views=("graded_t0",), sql="""SELECT model, count_if(correct) AS n_correct, count(*) AS n_rows, variant,
  row_number() OVER (ORDER BY model, variant) AS place FROM graded_t0 GROUP BY model, variant ORDER BY model, variant""")
def accuracy_ordered(spark, sf):
    """A result table in order, columns by name and rows by (model, variant); ``place`` is the row's place (result rows only)."""
    t = S.accuracy_table(graded_t0(spark, sf), ["model", "variant"]).select("n_correct", "model", "variant", "n_rows")
    t = t.select(*sorted(t.columns)).orderBy("model", "variant")
    return t.withColumn("place", F.row_number().over(Window.orderBy("model", "variant")).cast("bigint"))
