"""Catalogue: readers (S1, S2, S4, S6, S13) exercised on files Spark writes from the driver tables.

Each query lands the derived table in the reader's input layout under a fresh folder of the
shared checkpoint directory, then reads it back with the reader; the oracle is the table itself.
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources import readers as RD
from ..sources.tables import load_table
from .catalog import register
from .common import graded_t0

ENTRIES_PER_MAP_LINE = 5000


FILES_TASKS = 8   # case tasks that write together: each makes a file in every folder


def _sheets(spark, sf, df):
    """``df`` of a case view in fewer tasks for writing into folders, one after the other in each, so that files stay few."""
    return df.coalesce(max(spark.sparkContext.defaultParallelism, fx.case_tasks(spark, sf) // FILES_TASKS))


def _folder(spark, what: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{what}-{uuid.uuid4().hex}")


@register("src_responses", views=("responses_t0",), sql="SELECT case_id, model, variant, response FROM responses_t0")
def src_responses(spark, sf):
    """Headerless response sheets, one folder per (model, variant), read with an explicit schema."""
    root = _folder(spark, "sheets")
    _sheets(spark, sf, fx.responses_t0(spark, sf).select("case_id", "response", "model", "variant")).write.partitionBy("model", "variant").csv(root)
    return RD.read_response_sheets(spark, root)


@register("src_repetition_sheets", views=("responses_rep",), doubles=("temperature",),
          sql="SELECT case_id, temperature, model, run, response FROM responses_rep")
def src_repetition_sheets(spark, sf):
    """Wide repeat sheets (case_id, run1..run10) per (temperature, model) read and melted."""
    root = _folder(spark, "repeats")
    r = fx.responses_rep(spark, sf)
    runs = [f"run{i}" for i in fx.RUNS]
    wide = (r.groupBy("case_id", "model", "temperature")
            .agg(*[F.max(F.when(F.col("run") == i, F.col("response"))).alias(f"run{i}") for i in fx.RUNS]))
    _sheets(spark, sf, wide.select("case_id", *runs, "temperature", "model")).write.partitionBy("temperature", "model").csv(root)
    return RD.read_repetition_sheets(spark, root)


@register("src_questions", views=("questions",), sql="""SELECT case_key, case_id, case_text AS "case", question, options, answer,
  explanation, labs, has_table AS "table" FROM questions""")
def src_questions(spark, sf):
    """Question bank as JSON maps key -> {case, question, options, answer, explanation, labs, table};
    the writer spreads entries over map lines of bounded size, the reader explodes the maps."""
    root = _folder(spark, "questions")
    q = fx.questions(spark, sf)
    n = q.count()
    buckets = max(1, math.ceil(n / ENTRIES_PER_MAP_LINE))
    entry = F.struct(F.col("case_key").alias("k"), F.struct(
        F.col("case_text").alias("case"), "question", "options", "answer", "explanation", "labs",
        F.col("has_table").alias("table")).alias("v"))
    lines = (q.groupBy((F.abs(F.xxhash64("case_key")) % buckets).alias("b"))
             .agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")))
    lines.select("value").write.text(root)
    return RD.read_question_bank(spark, root, wholetext=False)


@register("json_map_entries", views=("questions",), sql="""SELECT case_key, case_id, case_text AS "case", question, options, answer,
  explanation, labs, has_table AS "table" FROM questions""")
def json_map_entries(spark, sf):
    """Question bank as files of one indented object each, read entry by entry whatever the splits of a file."""
    root = _folder(spark, "question_files")
    q = fx.questions(spark, sf)
    entry = F.struct(F.col("case_key").alias("k"), F.struct(
        F.col("case_text").alias("case"), "question", "options", "answer", "explanation", "labs", F.col("has_table").alias("table")).alias("v"))
    # some thousand cases an object, however many cases there are: the writer's rows stay bounded
    bucket = F.floor(F.col("case_id") / ENTRIES_PER_MAP_LINE)
    whole = q.groupBy(bucket.alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(entry)), {"pretty": "true"}).alias("value"))
    whole.write.partitionBy("file").text(root)
    return RD.read_question_bank(spark, root)


@register("src_generations", views=("generations",), sql=r"""SELECT regexp_extract(file_name, '^(.*)_promptID_(\d+)_output_(\d+)\.json$', 1) AS model,
  regexp_extract(file_name, '^(.*)_promptID_(\d+)_output_(\d+)\.json$', 2) AS prompt_id,
  CAST(regexp_extract(file_name, '^(.*)_promptID_(\d+)_output_(\d+)\.json$', 3) AS INT) AS experiment_id,
  CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS case_key, text FROM generations""")
def src_generations(spark, sf):
    """Generation maps case_key -> text; identity (model, prompt, experiment) from the file name."""
    root = _folder(spark, "generations")
    g = fx.generations(spark, sf).withColumn(
        "case_key", F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))
    # one map a line with one entry each: a file holds any number of lines, and no file's texts meet in one row
    lines = g.select("file_name", F.to_json(F.create_map("case_key", "text")).alias("value"))
    lines.select("value", F.col("file_name").alias("run")).write.partitionBy("run").text(root)
    return RD.read_generations(spark, root, wholetext=False)


@register("src_articles", views=("articles",), sql="SELECT db, year, doc_id, xml FROM articles")
def src_articles(spark, sf):
    """Articles packed by db and year, one JSON line each (a folder per document would be as many tiny files)."""
    root = _folder(spark, "articles")
    packed = fx.articles(spark, sf).select("db", "year", F.to_json(F.struct("doc_id", "xml")).alias("value"))
    packed.write.partitionBy("db", "year").text(root)
    return RD.read_packed_articles(spark, root)


_META = ["metric1", "metric2", "metric3", "metric4", "metric5"]


@register("src_ratings", views=("ratings",), doubles=("score",), sql="SELECT case_id, model, evaluator, metric, score FROM ratings")
def src_ratings(spark, sf):
    """Rating sheets (case and five metrics) per model and evaluator, narrower sheets left out, cells coerced to numbers."""
    root = _folder(spark, "ratings")
    r = fx.ratings(spark, sf)
    wide = r.groupBy("model", "evaluator", "case_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in _META])
    _sheets(spark, sf, wide.select("case_id", *_META, "model", "evaluator")).write.partitionBy("model", "evaluator").csv(root)
    return RD.read_checked_rating_sheets(spark, root, _META).select("case_id", "model", "evaluator", "metric", "score")


@register("src_judgements", views=("judgements",), doubles=("agreement",), sql="SELECT case_id, model, variant, truth_position, preferred, agreement FROM judgements")
def src_judgements(spark, sf):
    """Judgement sheets of both presentation orders, columns beyond the third dropped."""
    root = _folder(spark, "judgements")
    j = fx.judgements(spark, sf).withColumn("remark", F.lit("n/a"))
    _sheets(spark, sf, j.select("case_id", "preferred", "agreement", "remark", "model", "variant", "truth_position")).write.partitionBy("model", "variant", "truth_position").csv(root)
    return RD.read_judgement_sheets(spark, root)


@register("src_answers", views=("responses_machine2",), sql="SELECT case_id, model, response AS answer FROM responses_machine2")
def src_answers(spark, sf):
    """Answers CSV with header, projected."""
    root = _folder(spark, "answers")
    a = fx.responses_machine2(spark, sf).select("case_id", "model", F.col("response").alias("answer"), F.lit("x").alias("note"))
    _sheets(spark, sf, a).write.option("header", "true").csv(root)
    return RD.read_answers(spark, root)


@register("src_goals", views=("questions",), sql="SELECT case_key, CASE WHEN case_text = '' THEN '' ELSE explanation END AS goal FROM questions")
def src_goals(spark, sf):
    """Goal table CSV with its header row, empty goals kept."""
    root = _folder(spark, "goals")
    goal = F.when(F.col("case_text") == "", F.lit(None)).otherwise(F.col("explanation"))
    fx.questions(spark, sf).select("case_key", goal.alias("goal")).write.option("header", "true").csv(root)
    return RD.read_goals(spark, root)


@register("append_log", views=(), sql="SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def append_log(spark, sf):
    """Turns appended to a log role by role, each entry with its parameters as a struct, and read back."""
    root = _folder(spark, "log")
    c = load_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    entry = c.select("conv_id", "turn", "role", F.struct(F.length("text").alias("n_chars")).alias("parameters"))
    RD.append_log(entry.where("role = 'user'"), root)
    RD.append_log(entry.where("role <> 'user' OR role IS NULL"), root)
    return spark.read.schema(entry.schema).parquet(root).select("conv_id", "turn", "role", "parameters.n_chars")


@register("sink_tables", views=("graded_t0",), sql="SELECT model, variant, count(*) AS n, count_if(correct) AS n_correct FROM graded_t0 GROUP BY ALL")
def sink_tables(spark, sf):
    """A result table written as CSV with header and read back."""
    root = _folder(spark, "result")
    t = graded_t0(spark, sf).groupBy("model", "variant").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    RD.write_table(t, root, "csv")
    return spark.read.schema(t.schema).option("header", "true").csv(root)


@register("concatenated_json", views=(), sql="SELECT conv_id, turn, role, text, true AS ok FROM conversations")
def concatenated_json(spark, sf):
    """Turns written as indented JSON objects one behind the other, and read back by brace depth."""
    root = _folder(spark, "concatenated")
    c = load_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    RD.write_concatenated_json(c, root)
    return RD.read_concatenated_json(spark, root, c.schema).select("conv_id", "turn", "role", "text", "ok")
