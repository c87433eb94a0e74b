"""Catalogue: prompt tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.text import format_ci as fmt_ci
from ..functions.text import safe_name as safe
from ..operators import prompts as P
from ..sources import fixtures as fx
from ..sources.readers import read_prompt_templates
from .catalog import register
from .common import graded_t0
from .q_sources import _folder
from ..functions.stats import wilson_sql
from .q_agreement import VARIANT_PAIRS_SQL, prompt_agreement

_CI = wilson_sql("n_agreements", "n_cases")


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip_letters_sql(col: str) -> str:
    parts = [f"regexp_replace(split_part(string_split({col}, {_sq(m)})[-1], ';', 1), '\\.$', '')" for m in P.OPTION_MARKERS]
    return "concat_ws('; ', " + ", ".join(parts) + ")"


def _prompt_sql(options: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {_sq(k)} AS prompt_id, {_sq(s)} AS s, {_sq(e)} AS e" for k, (s, e) in P.PROMPTS.items())
    pad = _sq(P.PAD)
    return f"""SELECT t.prompt_id, q.case_key,
  t.s || {pad} || q.case_text || {pad} || q.question || {pad} || 'Options: ' || {options} || '.' || {pad} || t.e || {_sq(chr(10) + ' ' * 12)} AS prompt
FROM questions q, ({rows}) t WHERE length(q.case_text) > 0"""


@register("build_prompts", views=("questions",), sql=_prompt_sql("q.options"))
def build_prompts(spark, sf):
    """Prompt per (template, case), empty cases skipped."""
    return P.build_prompts(fx.questions(spark, sf))


@register("build_prompts_no_letter", views=("questions",), sql=_prompt_sql(_strip_letters_sql("q.options")))
def build_prompts_no_letter(spark, sf):
    """X10 + X11: prompts with the option letters removed."""
    return P.build_prompts(fx.questions(spark, sf), eliminate_letters=True)


@register("strip_option_letters", views=("questions",), sql=f"SELECT case_key, {_strip_letters_sql('options')} AS options FROM questions")
def strip_option_letters(spark, sf):
    """X11."""
    return fx.questions(spark, sf).select("case_key", P.strip_option_letters(F.col("options")).alias("options"))


_RUN = r"^(.*)_promptID_(\d+)_output_(\d+)\.json$"


@register("parse_run_name", views=("generations",), sql=f"""SELECT conv_id, turn, file_name,
  regexp_extract(file_name, '{_RUN}', 1) AS model, regexp_extract(file_name, '{_RUN}', 2) AS prompt_id,
  CAST(regexp_extract(file_name, '{_RUN}', 3) AS INT) AS experiment_id FROM generations""")
def parse_run_name(spark, sf):
    """Identity of a generation file from its name."""
    return P.parse_run_name(fx.generations(spark, sf)).drop("text")


@register("strip_prompt_echo", views=("generations",), sql="SELECT conv_id, turn, string_split(text, 'END')[-1] AS answer FROM generations")
def strip_prompt_echo(spark, sf):
    """The generated answer after the last prompt-end marker."""
    g = fx.generations(spark, sf)
    return g.select("conv_id", "turn", P.strip_prompt_echo(F.col("text"), "END").alias("answer"))


def _answers(spark, sf):
    g = P.parse_run_name(fx.generations(spark, sf))
    return g.select("model", "prompt_id", "experiment_id", F.col("conv_id").cast("string").alias("case_key"),
                    "turn", P.strip_prompt_echo(F.col("text"), "END").alias("answer"))


_ANSWERS_SQL = f"""SELECT regexp_extract(file_name, '{_RUN}', 1) AS model, regexp_extract(file_name, '{_RUN}', 2) AS prompt_id,
  CAST(regexp_extract(file_name, '{_RUN}', 3) AS INT) AS experiment_id, CAST(conv_id AS VARCHAR) AS case_key, turn,
  string_split(text, 'END')[-1] AS answer FROM generations"""


def _judge_sql(truth_last: bool) -> str:
    pad = _sq(P.PAD)
    gap = _sq("\n            \n            ")
    e1, e2 = ("a.answer", "q.explanation") if truth_last else ("q.explanation", "a.answer")
    label = "truth_last" if truth_last else "truth_first"
    return f"""SELECT a.model, a.prompt_id, a.experiment_id, a.case_key, a.turn, '{label}' AS order_label,
  {_sq(P.JUDGE_HEAD)} || {pad} || 'Clinical case: ' || q.case_text || '. ' || {pad} || 'Questions: ' || q.question || {pad}
  || 'Options: ' || q.options || '.' || {pad} || 'Explanation 1: ' || {e1} || '.' || {gap} || 'Explanation 2: ' || {e2} || '. ' || {gap}
  || {_sq(P.JUDGE_TAIL)} AS prompt, q.case_key IS NOT NULL AS has_question
FROM ({_ANSWERS_SQL}) a LEFT JOIN questions q ON q.case_key = a.case_key"""


@register("build_judge_prompts", views=("generations", "questions"), sql=_judge_sql(False))
def build_judge_prompts(spark, sf):
    """Self-evaluation prompts, reference explanation first."""
    return P.build_judge_prompts(_answers(spark, sf), fx.questions(spark, sf))


@register("build_judge_prompts_truth_last", views=("generations", "questions"), sql=_judge_sql(True))
def build_judge_prompts_truth_last(spark, sf):
    """Reference explanation second."""
    return P.build_judge_prompts(_answers(spark, sf), fx.questions(spark, sf), truth_last=True)


@register("upsert_latest", views=("generations",), sql=f"""SELECT model, prompt_id, experiment_id, case_key,
  max(turn) AS turn, max(row(turn, answer))[2] AS answer FROM ({_ANSWERS_SQL}) a GROUP BY ALL""")
def upsert_latest(spark, sf):
    """Per (model, prompt, experiment, case) the latest written answer wins."""
    return P.upsert_latest(_answers(spark, sf), ["model", "prompt_id", "experiment_id", "case_key"], "turn")


@register("config_registry", views=("generations",), sql=f"""SELECT model, experiment_id, prompt_id,
  CAST(row_number() OVER (PARTITION BY model ORDER BY experiment_id, prompt_id) - 1 AS INT) AS config_id
FROM (SELECT DISTINCT model, experiment_id, prompt_id FROM ({_ANSWERS_SQL}) a) r""")
def config_registry(spark, sf):
    """Experiment ids per model assigned as 'number of earlier configurations'."""
    runs = _answers(spark, sf).select("model", "experiment_id", "prompt_id").distinct()
    return P.config_registry(runs, order=("experiment_id", "prompt_id"))


@register("format_ci", views=("graded_t0",), sql=f"""SELECT model, a, b, replace(model || ' vs ' || a || ' vs ' || b, ' ', '_') AS label,
  printf('%.3f [%.3f, %.3f]', fixed_kappa, ci_low, ci_high) AS display
FROM (SELECT model, a, b, (n_agreements / n_cases - 0.2) / 0.8 AS fixed_kappa, {_CI[0]} AS ci_low, {_CI[1]} AS ci_high
      FROM (SELECT model, a, b, count(*) AS n_cases, count_if(x = y) AS n_agreements FROM ({VARIANT_PAIRS_SQL}) p GROUP BY ALL) s) t""")
def format_ci(spark, sf):
    """Display string 'k [lo, hi]' and a file-safe label per variant pair."""
    pa = prompt_agreement(spark, sf)
    return pa.select("model", "a", "b", safe(F.concat_ws(" vs ", "model", "a", "b")).alias("label"),
                     fmt_ci(F.col("fixed_kappa"), F.col("ci_low"), F.col("ci_high")).alias("display"))


@register("build_prompts_from_files", views=("questions",), sql=_prompt_sql("q.options"))
def build_prompts_from_files(spark, sf):
    """S5 + X10: prompt templates read from JSON files, then applied to every question."""
    root = _folder(spark, "templates")
    text = json.dumps({k: {"start": s, "end": e} for k, (s, e) in P.PROMPTS.items()})
    spark.range(1).select(F.lit(text).alias("value")).write.text(root)
    return P.build_prompts(fx.questions(spark, sf), templates=read_prompt_templates(spark, root))


@register("model_dim", views=("graded_t0",), sql="""SELECT 'hub/' || model AS repository, model, variant, count(*) AS n, count_if(correct) AS n_correct FROM graded_t0 GROUP BY ALL""")
def model_dim(spark, sf):
    """Results labelled with the repository of each model, from a dimension of the model labels."""
    labels = ", ".join(f"('{m}', 'hub/{m}')" for _, m in fx.MODELS)
    dim = spark.sql(f"SELECT * FROM VALUES {labels} AS t(model, repository)")
    counts = graded_t0(spark, sf).groupBy("model", "variant").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    return P.with_repository(counts, dim)
