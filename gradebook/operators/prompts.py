"""Prompt-table jobs (X10-X14, S7, S8): everything is a projection or an equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The two prompt templates (id -> start, end) and the prompt layouts.
PROMPTS = {
    "001": ("Given the following clinical case, consider the question, and provide the most likely answer among the "
            "provided options and the reasoning process behind your choice.",
            "Please, reduce the output to a paragraph and report the logic steps that led to your answer."),
    "002": ("Consider this clinical case, question, and options available.",
            "Please do provide your choice among the possible answers. Then provide the reasoning steps behind your choice."),
}
PAD = "\n\n            "
OPTION_MARKERS = ("A. ", "B. ", "C. ", "D. ", "E. ")
JUDGE_HEAD = ("Given the case the following clinical case and multiple choice question, I will provide you two potential "
              "explanations. \n            Can you please report the level of agreement from a scale from 0 (null agreement) "
              "to 5 (perfect agremeent) and select which response makes more clinical sense between the two explanations? ")
JUDGE_TAIL = ("Please state clearly which is the most clinical correct option between explanation 1 and explanation 2.\n"
              "            Then specify the agreement level between explanation 1 and explanation 2.")
RUN_NAME = r"^(.*)_promptID_(\d+)_output_(\d+)\.json$"


def strip_option_letters(options: Column) -> Column:
    """X11: for each letter, the text after 'X. ' up to ';', trailing '.' dropped, joined by '; '."""
    parts = []
    for m in OPTION_MARKERS:
        cand = F.substring_index(F.element_at(F.split(options, m.replace(".", r"\.")), -1), ";", 1)
        parts.append(F.regexp_replace(cand, r"\.$", ""))
    return F.concat_ws("; ", *parts)


def build_prompts(questions: DataFrame, eliminate_letters: bool = False, templates: DataFrame | None = None) -> DataFrame:
    """One prompt per (template, case) with a non-empty case text.

    Templates (the built-in ones, or rows prompt_id, start, end: a handful) are an array exploded per question row, no join."""
    tmpl = templates.agg(F.collect_list(F.struct("prompt_id", "start", "end"))).scalar() if templates is not None else F.array(*[F.struct(F.lit(k).alias("prompt_id"), F.lit(s).alias("start"), F.lit(e).alias("end"))
                     for k, (s, e) in PROMPTS.items()])
    q = questions.filter(F.length("case_text") > 0)
    opts = strip_option_letters(F.col("options")) if eliminate_letters else F.col("options")
    q = q.select("case_key", "case_text", "question", opts.alias("options"), F.explode(tmpl).alias("t"))
    text = F.concat(F.col("t.start"), F.lit(PAD), F.col("case_text"), F.lit(PAD), F.col("question"), F.lit(PAD),
                    F.lit("Options: "), F.col("options"), F.lit("."), F.lit(PAD), F.col("t.end"), F.lit("\n            "))
    return q.select(F.col("t.prompt_id").alias("prompt_id"), "case_key", text.alias("prompt"))


def parse_run_name(df: DataFrame, col: str = "file_name") -> DataFrame:
    """Model, prompt id and experiment id from '{model}_promptID_{p}_output_{n}.json'; another name gives '', '' and NULL."""
    return df.withColumns({
        "model": F.regexp_extract(col, RUN_NAME, 1),
        "prompt_id": F.regexp_extract(col, RUN_NAME, 2),
        "experiment_id": F.regexp_extract(col, RUN_NAME, 3).try_cast("int"),
    })


def strip_prompt_echo(text: Column, marker: str) -> Column:
    """The text after the last occurrence of the marker (whole text if absent)."""
    return F.substring_index(text, marker, -1)


def build_judge_prompts(answers: DataFrame, questions: DataFrame, truth_last: bool = False) -> DataFrame:
    """Judge prompt with the reference explanation first (or last) and the model's answer.  An answer without a
    question stays, with a NULL prompt and ``has_question`` false."""
    q = questions.select("case_key", "case_text", "question", "options", "explanation", F.lit(True).alias("_q"))
    j = answers.join(q, "case_key", "left")
    e1, e2 = (F.col("answer"), F.col("explanation")) if truth_last else (F.col("explanation"), F.col("answer"))
    text = F.concat(F.lit(JUDGE_HEAD), F.lit(PAD), F.lit("Clinical case: "), F.col("case_text"), F.lit(". "), F.lit(PAD),
                    F.lit("Questions: "), F.col("question"), F.lit(PAD), F.lit("Options: "), F.col("options"), F.lit("."), F.lit(PAD),
                    F.lit("Explanation 1: "), e1, F.lit("."), F.lit("\n            \n            "),
                    F.lit("Explanation 2: "), e2, F.lit(". "), F.lit("\n            \n            "), F.lit(JUDGE_TAIL))
    return j.select(*[c for c in answers.columns if c not in ("answer",)], F.lit("truth_last" if truth_last else "truth_first").alias("order_label"),
                    text.alias("prompt"), F.coalesce("_q", F.lit(False)).alias("has_question"))


def upsert_latest(log: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Later write wins per key (append-only log, one aggregate; no rewrite of the whole map).  Of writes with equal
    ``seq`` the one with the greatest values wins, so the result doesn't depend on the order of rows."""
    others = [seq, *(c for c in log.columns if c not in keys and c != seq)]
    latest = log.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r"))
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in log.columns if c not in keys])


def config_registry(runs: DataFrame, model: str = "model", order: Sequence[str] = ("experiment_id",)) -> DataFrame:
    """Next config id = number of earlier configs of the model (row_number - 1).

    The window is per model over its distinct run configurations (a handful)."""
    w = Window.partitionBy(model).orderBy(*order)
    return runs.withColumn("config_id", (F.row_number().over(w) - 1).cast("int"))


def with_repository(df: DataFrame, dim: DataFrame, label: str = "model") -> DataFrame:
    """``df`` with the ``repository`` of each model label, from the dimension (label, repository); a label it lacks stays, with NULL."""
    return df.join(dim.select(label, "repository"), label, "left").select("repository", *df.columns)
