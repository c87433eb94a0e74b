"""The pipeline against a brute-force version of its stages on a small table, and its registration."""

from brute import classes, contamination, cut_texts

import __spark_entry__
import corpus_pipeline
from gradebook.llm import line_dedup, mixing, toxicity
from gradebook.llm.common import table
from pyspark.sql import functions as F


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontamination", "mixing"]
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_equals_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"), F.lit(True))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    texts = cut_texts([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic], line_dedup.MIN_CHARS)
    comp, _ = classes(list(texts.items()), 80)
    texts = {d: t for d, t in texts.items() if comp[d] == d}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    hit = {r[0] for r in contamination(list(texts.items()), items) if r[-1]}
    texts = {d: t for d, t in texts.items() if d not in hit}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["text"] for r in got} == texts
    left = docs.where(F.col("doc_id").isin(*texts))
    plan = {r["doc_id"]: (r["slot"], r["position"], r["in_mix"]) for r in mixing.mix_sources(left.select("doc_id", "source")).collect()}
    assert {r["doc_id"]: (r["slot"], r["position"], r["in_mix"]) for r in got} == plan
