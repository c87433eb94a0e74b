"""Incremental landing as Structured Streaming queries.

Each job reads the files that arrive in a folder, works them off with ``trigger(availableNow=True)`` and stops; started
again, it resumes from its checkpoint, which lives in the shared folder named by ``spark.checkpoint.dir``.

* ``run_landing_stream`` (S14): drops ids already landed (same rule as ``operators.landing.skip_existing``), appends the rest.
* ``run_metadata_stream`` (S15): parses articles and appends their records; the batch number is the run id, so a batch that
  is repeated after a failure replaces what it wrote.
* ``run_sections_stream`` (S16): the latest write of each section is kept in the state store, keyed by section; a batch
  gives the sections whose latest write it changed.  State grows with the number of sections, not of writes; on a large
  corpus let the session use the RocksDB state store, which keeps it on disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import article_record
from ..operators.landing import append_metadata, read_if_there, skip_existing

CANDIDATE_SCHEMA = "db string, year int, doc_id bigint"
ARTICLE_SCHEMA = "db string, year int, doc_id bigint, xml string"
SECTION_KEY = ("db", "doc_id", "portion", "title")
SECTION_SCHEMA = "db string, doc_id bigint, portion string, title string, seq int, text string"


def _run(stream: DataFrame, land, checkpoint: str, mode: str = "append") -> None:
    q = (stream.writeStream.foreachBatch(land).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_landing_stream(spark: SparkSession, source_dir: str, landed_dir: str, checkpoint: str) -> None:
    def land(batch: DataFrame, epoch_id: int) -> None:
        fresh = batch.dropDuplicates(["db", "year", "doc_id"])
        landed = read_if_there(batch.sparkSession, landed_dir, CANDIDATE_SCHEMA)
        if landed is not None:
            fresh = skip_existing(fresh, landed)
        fresh.write.mode("append").partitionBy("db", "year").parquet(landed_dir)

    _run(spark.readStream.schema(CANDIDATE_SCHEMA).parquet(source_dir), land, checkpoint)


def run_metadata_stream(spark: SparkSession, source_dir: str, table: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    def land(batch: DataFrame, epoch_id: int) -> None:
        append_metadata(article_record(batch), table, f"batch-{epoch_id}")

    stream = spark.readStream.schema(ARTICLE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    _run(stream, land, checkpoint)


def run_sections_stream(spark: SparkSession, source_dir: str, changes_dir: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """S16 on a stream of section writes (``SECTION_SCHEMA``); of writes equal in seq the greatest text wins, as in ``upsert_latest``.

    ``changes_dir`` gets a folder for each batch, which a repeated batch writes anew; ``current_sections`` reads the latest state."""
    stream = spark.readStream.schema(SECTION_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    latest = stream.groupBy(*SECTION_KEY).agg(F.max(F.struct("seq", "text")).alias("w"))

    def land(batch: DataFrame, epoch_id: int) -> None:
        batch.select(*SECTION_KEY, "w.seq", "w.text").write.mode("overwrite").parquet(f"{changes_dir}/batch={epoch_id}")

    _run(latest, land, checkpoint, "update")


def current_sections(spark: SparkSession, changes_dir: str) -> DataFrame:
    """Each section as the last batch that changed it left it."""
    c = spark.read.schema(SECTION_SCHEMA + ", batch bigint").parquet(changes_dir)
    w = c.groupBy(*SECTION_KEY).agg(F.max_by(F.struct("seq", "text"), "batch").alias("w"))
    return w.select(*SECTION_KEY, "w.seq", "w.text")
