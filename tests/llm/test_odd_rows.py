"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from brute import base_figures, contamination, pii

import corpus_pipeline
from gradebook.llm import decontam, katz, language, line_dedup, mixing, near_dup, neighbours, quality, toxicity
from gradebook.llm import pii as pii_op

from pyspark.sql import functions as F

def ALL():
    return F.lit(True)


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (2, 0, 1), (3, None, 0), (13, 0, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def bench_of(spark):
    return spark.createDataFrame([(1, "summer days are long"), (None, "short text"), (3, None), (4, "")], "item_id long, text string")


def operators(spark, docs):
    labels, bench = labels_of(spark), bench_of(spark)
    return {
        "quality": lambda: quality.quality(docs),
        "language": lambda: language.identify(docs, language.fit(docs, ALL())),
        "near_dup": lambda: near_dup.near_duplicates(docs, 85),
        "pii": lambda: pii_op.digest(pii_op.find_spans(docs, pii_op.fit(docs))),
        "decontam": lambda: decontam.contamination(docs, bench),
        "katz": lambda: katz.katz_scores(docs, F.col("doc_id") > 2, F.col("doc_id") <= 2)[0],
        "neighbours": lambda: neighbours.score(docs, neighbours.fit(docs, labels, ALL())),
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(docs, labels, ALL())),
        "mixing": lambda: mixing.mix_sources(docs),
    }


NAMES = ["quality", "language", "near_dup", "pii", "decontam", "katz", "neighbours", "toxicity", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_one_result_for_each_row(spark, odd, name):
    rows = operators(spark, odd)[name]().collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert operators(spark, empty)[name]().count() == 0


def test_exact_figures_on_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = quality.quality(odd).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in got) == \
        sorted(str((i, *base_figures(t))) for i, t in rows)
    got = pii_op.digest(pii_op.find_spans(odd, {k: (0.0, [], float("inf")) for k in pii_op.FEATURES})).collect()
    assert sorted(str((r["doc_id"], r["spans"])) for r in got) == sorted(str((i, ",".join(pii(t)[1]))) for i, t in rows)
    bench = bench_of(spark)
    got = decontam.digest(decontam.contamination(odd, bench)).collect()
    want = contamination(rows, [("null" if r["item_id"] is None else r["item_id"], r["text"]) for r in bench.collect()])
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def test_near_duplicates_of_odd_rows(odd):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dup.near_duplicates(odd, 80).collect()}
    assert got[(2, 18)] == (1, False) and got[(3, 18)] == (1, False) and got[(1, 18)] == (1, True)
    assert got[(4, 0)] == (4, True) and got[(6, 0)] == (6, True) and got[(8, 1)] == (8, True) and got[(9, 1)] == (8, False)
    assert got[(None, 18)] == (None, True) and got[(None, 0)] == (None, True)


def test_lines_of_odd_rows(odd, empty):
    assert line_dedup.duplicate_lines(empty).count() == 0
    got = {(r["doc_id"], r["line_no"], r["edits"]) for r in line_dedup.duplicate_lines(odd).collect()}
    # the null doc_id stands first, so its sentence is the one that stays
    assert {(1, 0, 0), (2, 0, 0), (12, 1, 0), (12, 2, 1)} <= got and not any(x[0] in (4, 5, 6, 7, 8) for x in got)


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_stages_keep_columns(spark, odd, empty, which, tmp_path, real):
    docs = odd if which == "odd" else empty
    for t in ("labels", "benchmark", "documents"):
        real[t].write.parquet(f"{tmp_path}/{t}.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out-{k}")
        out = spark.read.parquet(f"{tmp_path}/out-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and (which == "odd") == (out.count() > 0), name
        docs = out
