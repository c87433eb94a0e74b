"""Landing: skip already-landed articles (S14) and append metadata records to the landed tables (S15).  The stream forms live in
``streaming``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA_KEY = ("db", "year", "doc_id")
_PLACE = [T.StructField("route", T.StringType()), T.StructField("run_id", T.StringType())]


def skip_existing(candidates: DataFrame, landed: DataFrame) -> DataFrame:
    """PMC candidates are skipped when their year and id are landed under pmc; all others (a NULL db too) when they are landed
    under any database.  One anti join on (year, doc_id) -- no scan of the file tree."""
    there = landed.select("year", "doc_id", (F.col("db") == "pmc").alias("_pmc")).alias("l")
    same = (F.col("c.year") == F.col("l.year")) & (F.col("c.doc_id") == F.col("l.doc_id")) & (
        F.col("l._pmc") | ~F.coalesce(F.col("c.db") == "pmc", F.lit(False)))
    return candidates.alias("c").join(there, same, "left_anti")


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """The table under ``path``, or None where nothing is written yet; any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_metadata(records: DataFrame, table: str, run_id: str, key: tuple[str, ...] = METADATA_KEY) -> None:
    """Append article records to the valid (``body_exists``) and invalid metadata tables under ``table``.

    The tables are one folder, partitioned by route (valid, invalid), run_id, db and year.  A record is appended if no other run has
    landed its key, whatever its route; of records equal in key one is kept (the least by its digest, so that a rerun keeps the
    same).  The job replaces the partitions of its own run and leaves all others alone, so a run that is repeated, after a
    failure or for no reason, ends in the same tables.  Runs of different ids must not write at the same time, and a
    repeated run must be given the records it was given before.

    Only the keys of the landed part are read, and only they and the new records are shuffled; no file of another run is written again."""
    spark = records.sparkSession
    whole = F.struct(*records.columns)
    one = records.groupBy(*key).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("_r")).select("_r.*")
    fresh = one.withColumns({"route": F.when(F.col("body_exists"), "valid").otherwise("invalid"), "run_id": F.lit(run_id)})
    landed = read_if_there(spark, table, T.StructType([*records.schema.fields, *_PLACE]))
    if landed is not None:
        there = landed.where(F.col("run_id") != run_id).select(*[F.col(k).alias(f"_{k}") for k in key])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        fresh = fresh.join(there, same, "left_anti")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route", "run_id", "db", "year").parquet(table)


def metadata_table(spark: SparkSession, table: str, schema: T.StructType, route: str | None = None) -> DataFrame:
    """The landed records (columns of ``schema``, route, run_id), of one route or both."""
    df = spark.read.schema(T.StructType([*schema.fields, *_PLACE])).parquet(table)
    return df if route is None else df.where(F.col("route") == route)
