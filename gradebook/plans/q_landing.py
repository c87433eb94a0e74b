"""Catalogue: landing (S14) in batch and streaming form (2.11)."""

from __future__ import annotations

import os
import uuid

from ..operators.landing import skip_existing
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources.tables import load_table
from ..streaming.landing_stream import CANDIDATE_SCHEMA, run_landing_stream
from .catalog import register

_SKIP_SQL = """WITH cand AS (SELECT db, year, doc_id FROM articles),
landed AS (SELECT DISTINCT a.db, a.year, a.doc_id FROM articles a JOIN labels l ON l.doc_id = a.doc_id)
SELECT c.db, c.year, c.doc_id FROM cand c WHERE NOT EXISTS (SELECT 1 FROM landed l WHERE l.year = c.year AND l.doc_id = c.doc_id AND (l.db = 'pmc' OR c.db <> 'pmc'))"""


def _candidates_and_landed(spark, sf):
    arts = fx.articles(spark, sf).select("db", "year", "doc_id")
    landed = arts.join(load_table(spark, sf, "labels", ["doc_id"]).distinct(), "doc_id", "left_semi").select("db", "year", "doc_id")
    return arts, landed


@register("landing_skip_existing", views=("articles",), sql=_SKIP_SQL)
def landing_skip_existing(spark, sf):
    """Candidate articles minus those already landed (landed = articles with labels)."""
    cand, landed = _candidates_and_landed(spark, sf)
    return skip_existing(cand, landed)


@register("stream_landing_batch", views=("articles",), sql=_SKIP_SQL)
def stream_landing_batch(spark, sf):
    """2.11: the same landing run as a Structured Streaming query (availableNow, foreachBatch, checkpoint)."""
    base = os.path.join(checkpoint_dir(spark), "landing-" + uuid.uuid4().hex)
    src, out, ck = f"{base}/candidates", f"{base}/landed", f"{base}/_checkpoint"
    cand, landed = _candidates_and_landed(spark, sf)
    landed.write.partitionBy("db", "year").parquet(out)
    cand.write.parquet(src)
    run_landing_stream(spark, src, out, ck)
    return spark.read.schema(CANDIDATE_SCHEMA).parquet(out).join(landed, ["db", "year", "doc_id"], "left_anti").select("db", "year", "doc_id")
