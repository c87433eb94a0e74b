"""Grading: normalise sheet cells, categorise, mask to valid options, compare with the key.

``grade`` produces the long fact table every summary reads:
``(keys..., case_id, response, category, valid, is_valid, correct)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import OPTIONS, normalize_response, response_category, valid_option


def grade(responses: DataFrame, truth: DataFrame | None = None, options=OPTIONS, normalize: bool = True,
          response_col: str = "response") -> DataFrame:
    """Add category / valid / correct columns.

    ``truth`` (case_id, truth) is joined on case_id when the responses do not carry it; the
    join is a plain equi-join so Spark chooses broadcast only when the key table is small.
    ``normalize=False`` keeps the raw cell for validity (the reference's accuracy rule, K1).
    """
    df = responses
    if truth is not None and "truth" not in df.columns:
        df = df.join(truth.select("case_id", "truth"), "case_id", "left")
    # normalise in its own projection; the later expressions reference the column, so the
    # (possibly large) producer expression is not duplicated into each of them
    df = df.withColumn("_raw", F.col(response_col)).withColumn(response_col, normalize_response(F.col(response_col)))
    r = F.col(response_col)
    df = df.withColumn("valid", valid_option(r if normalize else F.col("_raw"), options))
    return df.withColumns({
        "category": response_category(r),
        "is_valid": F.col("valid").isNotNull(),
        "correct": F.coalesce(F.col("valid") == F.col("truth"), F.lit(False)),
    }).drop("_raw")


def ground_truth(questions: DataFrame) -> DataFrame:
    """Truth letter and covariates from the question bank: first letter of the answer, Yes/No flags."""
    first = F.upper(F.substring(F.trim(F.col("answer")), 1, 1))
    return questions.select(
        "case_id",
        F.when(first == "", F.lit(None)).otherwise(first).alias("truth"),
        (F.col("labs") == "Yes").alias("labs"),
        (F.col("has_table") == "Yes").alias("has_table"),
    )


def exclude_cases(df: DataFrame, excluded: DataFrame, key: str = "case_id") -> DataFrame:
    """Drop listed cases (anti join; Spark broadcasts the exclusion list when it is small)."""
    return df.join(excluded.select(key), key, "left_anti")


def completeness_check(responses: DataFrame, case_set: DataFrame, group_keys: list[str]) -> DataFrame:
    """Violations of "each sheet holds exactly the case set" as rows (keys..., case_id, problem).

    ``unexpected``: a sheet row whose case is not in the case set; ``missing``: a case of the set absent from a sheet.
    Sheets and case set are brought together by one aggregate by case, which holds the sheets that have it (at most the number of
    sheets); the list of all sheets, one entry a sheet, is a scalar subquery.  No sheets x cases grid is built.
    """
    of = F.struct(*group_keys)
    sheets = responses.select(of.alias("g")).distinct().agg(F.collect_list("g").alias("gs")).scalar()
    both = responses.select("case_id", of.alias("g"), F.lit(False).alias("_set")).unionByName(
        case_set.select("case_id", F.lit(True).alias("_set")), allowMissingColumns=True)
    seen = both.groupBy("case_id").agg(F.collect_set("g").alias("gs"), F.bool_or("_set").alias("_set"))
    seen = seen.withColumn("_absent", F.array_except(sheets, F.col("gs")))
    missing = F.transform("_absent", lambda g: F.struct(g.alias("g"), F.lit("missing").alias("problem")))
    unexpected = F.transform("gs", lambda g: F.struct(g.alias("g"), F.lit("unexpected").alias("problem")))
    rows = seen.select("case_id", F.explode(F.when(F.col("_set"), missing).otherwise(unexpected)).alias("v"))
    return rows.select(*[F.col(f"v.g.{k}").alias(k) for k in group_keys], "case_id", "v.problem")
