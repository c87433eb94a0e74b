"""Catalogue: reshape."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import reshape as RS
from ..operators import summary as S
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from .catalog import register
from .common import REP_KEYS, graded_m2, graded_rep, graded_t0, per_case_rep

SHEETS = [(m, v) for _, m in fx.MODELS for _, v in fx.VARIANTS]
METRICS = [f"metric{k}" for k in range(1, 6)]
RUN_COLS = [f"run{r}" for r in fx.RUNS]


@register("wide_responses", views=("graded_t0",), sql="SELECT case_id, " + ", ".join(
    f"max(CASE WHEN model = '{m}' AND variant = '{v}' THEN valid END) AS {m}_{v}" for m, v in SHEETS) + " FROM graded_t0 GROUP BY case_id")
def wide_responses(spark, sf):
    """One column per (model, variant) sheet, valid answers, one row per case (known column list)."""
    g = graded_t0(spark, sf).withColumn("sheet", F.concat_ws("_", "model", "variant"))
    return RS.wide_by(g, ["case_id"], "sheet", [f"{m}_{v}" for m, v in SHEETS], "valid")


_RW_SQL = "SELECT model, evaluator, case_id, " + ", ".join(
    f"max(CASE WHEN metric = '{k}' THEN score END) AS {k}" for k in METRICS) + " FROM ratings GROUP BY model, evaluator, case_id"


@register("ratings_wide", views=("ratings",), doubles=tuple(METRICS), sql=_RW_SQL)
def ratings_wide(spark, sf):
    """Rating sheet layout (one column per metric)."""
    return RS.wide_by(fx.ratings(spark, sf), ["model", "evaluator", "case_id"], "metric", METRICS, "score")


@register("ratings_long", views=("ratings",), doubles=("score",), sql=f"""SELECT model, evaluator, case_id, metric, score
FROM ({_RW_SQL}) w UNPIVOT INCLUDE NULLS (score FOR metric IN ({', '.join(METRICS)}))""")
def ratings_long(spark, sf):
    """Melt a wide rating sheet back to (model, evaluator, case_id, metric, score)."""
    w = RS.wide_by(fx.ratings(spark, sf), ["model", "evaluator", "case_id"], "metric", METRICS, "score")
    return RS.long_from(w, ["model", "evaluator", "case_id"], METRICS, "metric", "score")


@register("likert_counts", views=("ratings",), sql="SELECT model, metric, " + ", ".join(
    f"count_if(score = {s}) AS s{s}" for s in range(1, 6)) + " FROM ratings GROUP BY model, metric")
def likert_counts(spark, sf):
    """Zero-filled Likert counts per (model, metric), one column per level."""
    r = fx.ratings(spark, sf)
    return r.groupBy("model", "metric").agg(*[F.count_if(F.col("score") == s).alias(f"s{s}") for s in range(1, 6)])


@register("transpose_counts", views=("graded_rep",), sql="SELECT temperature, run, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN n_correct END) AS {m}" for _, m in fx.MODELS) + """
FROM (SELECT temperature, model, run, count_if(correct) AS n_correct FROM graded_rep GROUP BY ALL) r GROUP BY temperature, run""")
def transpose_counts(spark, sf):
    """Runs as rows, models as columns (correct counts) per temperature."""
    runs = S.accuracy_by_run(graded_rep(spark, sf), REP_KEYS)
    return RS.wide_by(runs, ["temperature", "run"], "model", [m for _, m in fx.MODELS], "n_correct")


@register("union_tables", views=("graded_t0", "graded_m2"), sql="""SELECT 'machine1' AS machine, model, case_id, response FROM graded_t0 WHERE variant = 'prompt1'
UNION ALL SELECT 'machine2', model, case_id, response FROM graded_m2""")
def union_tables(spark, sf):
    """R2/S3: row-bind the sheets of two machines with a machine tag."""
    a = graded_t0(spark, sf).filter(F.col("variant") == "prompt1").select(F.lit("machine1").alias("machine"), "model", "case_id", "response")
    b = graded_m2(spark, sf).select(F.lit("machine2").alias("machine"), "model", "case_id", "response")
    return RS.union_tables([a, b])


@register("src_repetitions", views=("responses_rep",), sql="""SELECT temperature, model, case_id, run, response FROM responses_rep""")
def src_repetitions(spark, sf):
    """A repeat sheet (case_id, run1..run10) per (temperature, model) unpivoted to long form."""
    r = fx.responses_rep(spark, sf)
    wide = RS.wide_by(r, ["case_id", "model", "temperature"], "run", fx.RUNS, "response", name=lambda v: f"run{v}")  # the case first: its rows lie together
    long = RS.long_from(wide, ["temperature", "model", "case_id"], RUN_COLS, "run", "response")
    return long.withColumn("run", F.expr("substr(run, 4)").cast("int"))


@register("variant_split", views=("graded_t0",), sql="SELECT case_id, " + ", ".join(
    f"max(CASE WHEN model = '{m}' AND variant = 'prompt1' THEN valid END) AS {m}" for _, m in fx.MODELS) + " FROM graded_t0 GROUP BY case_id")
def variant_split(spark, sf):
    """The sheets of one variant, picked by column suffix, under their model's name."""
    wide = wide_responses(spark, sf)
    return wide.select("case_id", *[F.col(c).alias(c.removesuffix("_prompt1")) for c in wide.columns if c.endswith("_prompt1")])


@register("case_order", views=("per_case_rep",), sql="""SELECT temperature, model, case_id, n_correct,
  row_number() OVER (PARTITION BY temperature, model ORDER BY n_correct, case_id) AS position FROM per_case_rep""")
def case_order(spark, sf):
    """Cases in order of correctness, then id, within (temperature, model).

    The cut points, the counts and the ranks each read the cases: they are worked out from the answers once, and written."""
    path = os.path.join(checkpoint_dir(spark), f"per-case-{uuid.uuid4().hex}")
    per_case = per_case_rep(spark, sf).select(*REP_KEYS, "case_id", "n_correct")
    per_case.write.parquet(path)
    return S.case_order(spark.read.schema(per_case.schema).parquet(path), REP_KEYS)
