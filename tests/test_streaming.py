"""Landing stream: incremental runs resume from the checkpoint and never land an id twice."""

import pytest
from pyspark.errors import StreamingQueryException

from gradebook.operators import corpus as C
from gradebook.operators import landing as L
from gradebook.streaming.landing_stream import (ARTICLE_SCHEMA, CANDIDATE_SCHEMA, SECTION_SCHEMA, current_sections, run_landing_stream,
                                                run_metadata_stream, run_sections_stream)


def test_landing_stream_resumes(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "landed"), str(tmp_path / "ck")
    first = spark.createDataFrame([("pmc", 2020, 1), ("pmc", 2020, 2), ("pubmed", 2021, 3)], CANDIDATE_SCHEMA)
    first.write.mode("append").parquet(src)
    run_landing_stream(spark, src, out, ck)
    # second batch: one new id, one id of the same year already landed under pmc (skipped for pubmed too), one duplicate,
    # and a landed id in another year, which is another article folder
    second = spark.createDataFrame([("pmc", 2022, 4), ("pubmed", 2020, 1), ("pmc", 2020, 2), ("pubmed", 2022, 1)], CANDIDATE_SCHEMA)
    second.write.mode("append").parquet(src)
    run_landing_stream(spark, src, out, ck)
    landed = sorted((r.db, r.doc_id) for r in spark.read.schema(CANDIDATE_SCHEMA).parquet(out).collect())
    assert landed == [("pmc", 1), ("pmc", 2), ("pmc", 4), ("pubmed", 1), ("pubmed", 3)]


BODY = '<article><front><article-meta><article-id pub-id-type="pmc">P{0}</article-id></article-meta></front><body><sec id="s"><title>T{0}</title></sec><sec id="s"><title>U</title></sec></body></article>'


def articles(spark, ids, db="pmc"):
    return spark.createDataFrame([(db, 2020 + i % 2, i, BODY.format(i) if i % 3 else "<article>cut") for i in ids], ARTICLE_SCHEMA)


def rows(spark, table, schema):
    return sorted((r.route, r.run_id, r.db, r.year, r.doc_id, r.article_key, tuple(r.body_titles.items())) for r in L.metadata_table(spark, table, schema).collect())


def test_metadata_append_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "t")
    first, second = C.article_record(articles(spark, [1, 2, 3])), C.article_record(articles(spark, [2, 3, 4, 5, 5, 6]).union(articles(spark, [1], None)))
    L.append_metadata(first, table, "a")
    L.append_metadata(second, table, "b")
    once = sorted(map(str, [(r.route, r.run_id, r.db, r.year, r.doc_id) for r in L.metadata_table(spark, table, first.schema).collect()]))
    assert len(once) == 7 and sum("'b'" in x for x in once) == 4
    for run, records in (("b", second), ("a", first), ("b", second)):
        L.append_metadata(records, table, run)
        again = sorted(map(str, [(r.route, r.run_id, r.db, r.year, r.doc_id) for r in L.metadata_table(spark, table, first.schema).collect()]))
        assert again == once
    valid = {r.doc_id: r for r in L.metadata_table(spark, table, first.schema, "valid").where("db = 'pmc'").collect()}
    assert sorted(valid) == [1, 2, 4, 5] and valid[4].body_titles == {"s": "U"} and valid[4].article_key == "P4" and valid[4].year == 2020
    assert all(r.body_titles == {} and r.parse_error for r in L.metadata_table(spark, table, first.schema, "invalid").where("doc_id IN (3, 6)").collect())


def test_metadata_stream_repeats_a_failed_batch(spark, tmp_path, monkeypatch):
    """A batch that fails after its write is run again and leaves one record a key."""
    from gradebook.streaming import landing_stream
    src, table, ck = (str(tmp_path / x) for x in ("src", "t", "ck"))
    articles(spark, [1, 2]).coalesce(1).write.parquet(src)
    real, fail = landing_stream.append_metadata, [True]

    def breaks_once(*args):
        real(*args)
        if fail.pop():
            raise RuntimeError("lost")
    monkeypatch.setattr(landing_stream, "append_metadata", lambda *args: breaks_once(*args) if fail else real(*args))
    with pytest.raises(StreamingQueryException):
        run_metadata_stream(spark, src, table, ck)
    articles(spark, [2, 4]).coalesce(1).write.mode("append").parquet(src)
    run_metadata_stream(spark, src, table, ck)
    schema = C.article_record(articles(spark, [1])).schema
    assert sorted((x[1], x[4]) for x in rows(spark, table, schema)) == [("batch-0", 1), ("batch-0", 2), ("batch-1", 4)]


def test_sections_stream_keeps_latest_in_state(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))

    def write(rows):
        spark.createDataFrame(rows, SECTION_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def state():
        return sorted((r.doc_id, r.seq, r.text) for r in current_sections(spark, out).collect())
    write([("pmc", 1, "body", "A", 1, "x"), ("pmc", 2, "body", "A", 5, "late"), ("pmc", 1, "body", "A", 1, "y")])
    run_sections_stream(spark, src, out, ck)
    assert state() == [(1, 1, "y"), (2, 5, "late")]
    # an older write that comes later doesn't win, a newer one does; what an earlier run saw is in the state
    write([("pmc", 2, "body", "A", 4, "old"), ("pmc", 1, "body", "A", 2, "new"), (None, 3, None, None, None, None)])
    run_sections_stream(spark, src, out, ck)
    assert sorted(map(str, state())) == sorted(map(str, [(1, 2, "new"), (2, 5, "late"), (3, None, None)]))
