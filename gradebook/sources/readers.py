"""Readers for the input layouts (S1-S6, S10-S13, S17, S19) and the table sinks.

Every reader has an explicit schema (no inference), reads a directory (many files = many
tasks) and takes identity (model, variant, temperature, db, year, ...) from partition folders
or from ``_metadata.file_name``; nothing is read through the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_stream import read_items

QUESTION_FIELDS = ["case", "question", "options", "answer", "explanation", "labs", "table"]
QUESTION_TYPE = T.MapType(T.StringType(), T.StructType([T.StructField(f, T.StringType()) for f in QUESTION_FIELDS]))
TEXT_MAP_TYPE = T.MapType(T.StringType(), T.StringType())
RUN_NAME = r"^(.*)_promptID_(\d+)_output_(\d+)\.json$"


def read_response_sheets(spark: SparkSession, root: str) -> DataFrame:
    """Headerless sheets ``case_id,response[,...]`` under ``root/model=*/variant=*/``."""
    schema = "case_id BIGINT, response STRING"
    df = spark.read.schema(schema).option("header", "false").option("mode", "PERMISSIVE").csv(root)
    return df.select("case_id", "model", "variant", F.col("response"))


def read_repetition_sheets(spark: SparkSession, root: str, runs: int = 10) -> DataFrame:
    """``case_id,run1..runN`` sheets under ``root/temperature=*/model=*/`` melted to long form."""
    cols = [f"run{i}" for i in range(1, runs + 1)]
    schema = "case_id BIGINT, " + ", ".join(f"{c} STRING" for c in cols)
    df = spark.read.schema(schema).option("header", "false").csv(root)
    # the run's number comes along with its cell: no name to be taken apart for each of them
    cells = F.array(*[F.struct(F.lit(i).alias("run"), F.col(c).alias("response")) for i, c in enumerate(cols, 1)])
    long = df.select("case_id", F.col("temperature").cast("double").alias("temperature"), "model", F.explode(cells).alias("_c"))
    return long.select("case_id", "temperature", "model", "_c.run", "_c.response")


def read_json_maps(spark: SparkSession, root: str, value_type: T.DataType, wholetext: bool = True) -> DataFrame:
    """S4/S6 core: JSON objects ``key -> value``; one row per entry + the file path.

    ``wholetext`` reads each file as one (possibly pretty-printed) object of any size, entry by entry and by as many tasks as it has
    splits (``json_stream``); an entry that doesn't parse gives no row.  Otherwise every line is one object (large maps split
    over many lines/files by the writer)."""
    if wholetext:
        items = read_items(spark, root, ",", 1)
        opened = F.when(F.col("place") == 0, F.regexp_replace("item", r"^[\s\uFEFF]*\{", "")).otherwise(F.expr("substr(item, 2)"))
        body = F.when(F.col("shut"), F.regexp_replace(opened, r"\}[^}]*\z", "")).otherwise(opened)
        raw = items.select("file_path", F.concat(F.lit("{"), body, F.lit("}")).alias("value"))
    else:
        raw = spark.read.text(root).select("value", F.col("_metadata.file_path").alias("file_path"))
    m = raw.select("file_path", F.from_json("value", value_type).alias("m"))
    return m.select("file_path", F.explode("m").alias("key", "value"))


def read_question_bank(spark: SparkSession, root: str, wholetext: bool = True) -> DataFrame:
    """Question bank map -> (case_key, case_id, fields...)."""
    e = read_json_maps(spark, root, QUESTION_TYPE, wholetext)
    return e.select(F.col("key").alias("case_key"), F.col("key").try_cast("bigint").alias("case_id"),
                    *[F.col(f"value.{f}").alias(f) for f in QUESTION_FIELDS])


def read_generations(spark: SparkSession, root: str, wholetext: bool = True) -> DataFrame:
    """Generation maps; model, prompt id and experiment id parsed from the file (or folder) name."""
    e = read_json_maps(spark, root, TEXT_MAP_TYPE, wholetext)
    name = F.regexp_extract("file_path", r"([^/=]+_promptID_\d+_output_\d+\.json)", 1)
    e = e.withColumn("file_name", name)
    return e.select(F.regexp_extract("file_name", RUN_NAME, 1).alias("model"),
                    F.regexp_extract("file_name", RUN_NAME, 2).alias("prompt_id"),
                    F.regexp_extract("file_name", RUN_NAME, 3).try_cast("int").alias("experiment_id"),
                    F.col("key").alias("case_key"), F.col("value").alias("text"))


def read_rating_sheets(spark: SparkSession, root: str, metrics: list[str]) -> DataFrame:
    """``case_id`` + one column per metric under ``root/model=*/evaluator=*/``; cells coerced with
    ``try_cast`` (text becomes NULL, as a numeric coercion would).  Extra columns are ignored."""
    cols = ["case_id"] + metrics
    schema = ", ".join(f"`{c}` STRING" for c in cols) + ", `_extra` STRING"
    df = spark.read.schema(schema).option("header", "false").option("enforceSchema", "true").csv(root)
    df = df.withColumns({"source_file": F.col("_metadata.file_name"), "file_path": F.col("_metadata.file_path")})
    long = df.unpivot(["case_id", "model", "evaluator", "source_file", "file_path"], metrics, "metric", "raw")
    return long.select(F.expr("try_cast(case_id AS BIGINT)").alias("case_id"), "model", "evaluator", "metric",
                       F.expr("try_cast(raw AS DOUBLE)").alias("score"), "source_file", "file_path")


def sheet_widths(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(file_path, n_columns) of delimited sheets: the widest line of each file; commas inside quotes don't part columns."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    line = F.regexp_replace("value", r'"(?:[^"\\]|\\.|"")*"', "")
    return raw.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.max(F.size(F.split(line, ",", -1))).alias("n_columns"))


def narrow_sheets(spark: SparkSession, root: str, least: int = 6) -> DataFrame:
    """The sheets that ``read_checked_rating_sheets`` leaves out, (file_path, n_columns), to be reported."""
    return sheet_widths(spark, root).where(F.col("n_columns") < least)


def read_checked_rating_sheets(spark: SparkSession, root: str, metrics: list[str], least: int = 6) -> DataFrame:
    """S10 with its check: sheets of fewer than ``least`` columns are left out (``narrow_sheets`` names them).  Files are told apart by
    their whole path: files of one name in different folders are different sheets."""
    wide_enough = sheet_widths(spark, root).where(F.col("n_columns") >= least).select("file_path")
    return read_rating_sheets(spark, root, metrics).join(wide_enough, "file_path", "left_semi").drop("file_path")


def read_judgement_sheets(spark: SparkSession, root: str) -> DataFrame:
    """``case_id,preferred,agreement[,...]`` under ``root/model=*/variant=*/truth_position=*/``; further columns are dropped."""
    df = spark.read.schema("case_id STRING, preferred STRING, agreement STRING, _extra STRING").option("header", "false").csv(root)
    return df.select(F.expr("try_cast(case_id AS BIGINT)").alias("case_id"), "model", "variant", F.col("truth_position").cast("int").alias("truth_position"),
                     F.expr("try_cast(preferred AS INT)").alias("preferred"), F.expr("try_cast(agreement AS DOUBLE)").alias("agreement"))


def read_answers(spark: SparkSession, root: str) -> DataFrame:
    """Answers CSV with header, projected to case, model and answer."""
    df = spark.read.schema("case_id STRING, model STRING, answer STRING, note STRING").option("header", "true").csv(root)
    return df.select(F.expr("try_cast(case_id AS BIGINT)").alias("case_id"), "model", "answer")


def read_prompt_templates(spark: SparkSession, root: str) -> DataFrame:
    """JSON maps prompt_id -> {start, end}."""
    pair = T.MapType(T.StringType(), T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]))
    return read_json_maps(spark, root, pair).select(F.col("key").alias("prompt_id"), "value.start", "value.end")


def append_log(entries: DataFrame, path: str) -> None:
    """Append-only log; one write adds files and never rewrites what is there."""
    entries.write.mode("append").parquet(path)


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """One XML document per file under ``root/{db}/{year}/{id}.xml`` (or the equivalent
    ``db=/year=/doc_id=`` partition folders)."""
    raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("p"))
    flat = r"/([^/=]+)/(\d{4})/(\d+)\.xml$"
    part = r"/db=([^/]+)/year=(\d{4})/doc_id=(\d+)/"

    def pick(i: int) -> Column:
        return F.when(F.regexp_extract("p", flat, i) != "", F.regexp_extract("p", flat, i)).otherwise(F.regexp_extract("p", part, i))

    return raw.select(pick(1).alias("db"), pick(2).try_cast("int").alias("year"), pick(3).try_cast("bigint").alias("doc_id"),
                      F.col("value").alias("xml"))


def read_packed_articles(spark: SparkSession, root: str) -> DataFrame:
    """S13 at scale: JSON lines ``{doc_id, xml}`` under ``root/db=*/year=*/``; a line that is no such object gives a NULL xml."""
    schema = "doc_id BIGINT, xml STRING, db STRING, year INT"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(root).select("db", "year", "doc_id", "xml")


def write_concatenated_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each row as an indented JSON object, one behind the other, without an array around them and without commas."""
    whole = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(whole.alias("value")).write.mode(mode).text(path)


def split_concatenated(text: str) -> list[str]:
    """The top-level objects of concatenated JSON, cut at brace depth; braces inside strings don't count.  What is behind the last
    closed object (a cut-off one) comes as a last piece."""
    out, start, depth = [], None, 0
    for m in _STRUCTURE.finditer(text):
        c = m.group()
        if c == "{":
            if depth == 0:
                start = m.start()
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start:m.end()])
                start = None
    return out if start is None else [*out, text[start:]]


#: a whole string (closed or cut off), or a brace
_STRUCTURE = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.S)


def read_concatenated_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects written one behind the other, with or without white space between and inside them: (file_path, place, ok, columns of
    ``schema``).  An object that is cut off or doesn't parse has ``ok`` false and NULL columns.  A file is read by as many tasks as it has
    splits (``json_stream``)."""
    items = read_items(spark, path, "{", 0).where("startswith(item, '{')")  # what stands before a file's first object is its item 0
    closed = F.when(F.col("shut"), F.regexp_extract("item", r"(?s)^(.*\})", 1)).otherwise(F.col("item"))
    pieces = items.select("file_path", (F.col("place") - 1).alias("place"), closed.alias("object"))
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    checked = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = pieces.withColumn("_o", F.from_json("object", checked))
    ok = F.col("_o").isNotNull() & F.col("_o._corrupt_record").isNull()
    return parsed.select("file_path", "place", ok.alias("ok"), *[F.when(ok, F.col("_o")[f.name]).alias(f.name) for f in kind.fields])


def read_goals(spark: SparkSession, path: str) -> DataFrame:
    """Two-column CSV (case_key, goal) whose header row is ``,0``; empty goals kept as ''."""
    df = spark.read.schema("case_key STRING, goal STRING").option("header", "true").csv(path)
    return df.select("case_key", F.coalesce(F.col("goal"), F.lit("")).alias("goal"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Result tables as Parquet (default), CSV with header, or JSON lines."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
