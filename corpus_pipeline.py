"""Corpus pipeline: the stages that turn ``documents`` into a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``.

* toxicity: drops documents scored 0.5 or more by the model of ``labels``.
* line_dedup: cuts lines that stand earlier in the corpus out of the texts; drops documents of which nothing new is left.
* near_dup: keeps one document of each near-duplicate class (similarity 0.8 of five-word shingles).
* decontamination: drops documents that hold a window of a ``benchmark`` item.
* mixing: gives every document its place in the mix of sources; adds units, block, slot, release, deadline, position, in_mix.

toxicity, line_dedup and decontamination decide on each row by its own text; lines are compared in order of (doc_id, text hash,
line).  near_dup tells rows apart by (doc_id, text hash): of each class the row of the smallest doc_id stays, of rows equal in doc_id and
text one; a null doc_id is compared with nothing there and kept.  Null and empty texts pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.llm import decontam, line_dedup, mixing, near_dup, toxicity
from gradebook.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_clean(docs, model, 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_duplicate_lines(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs


# MinHash classes can't be written in SQL; tests/llm/test_pipeline.py holds the result against a brute-force version
ORACLE_SQL = None
