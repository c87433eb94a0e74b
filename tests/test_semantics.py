"""Quirk rules (SURVEY K-rows), resampling, ranks, corpus and prompt helpers on small hand-written frames."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradebook.functions.random import uniform_sql
from gradebook.operators import corpus as C
from gradebook.operators import judging as J
from gradebook.operators import grading as G
from gradebook.operators import prompts as P
from gradebook.operators import resample as R
from gradebook.operators import summary as S
from gradebook.operators import agreement as A
from gradebook.operators.ranking import bijection, hash_rank, order_rank, with_bucket


def test_grade_normalises_and_masks(spark):
    df = spark.createDataFrame([(1, " a ", "A"), (2, "A-C", "A"), (3, "hall", "B"), (4, None, "B"), (5, "CHECK", "C"), (6, "", "C")],
                               "case_id long, response string, truth string")
    g = {r.case_id: r for r in G.grade(df).collect()}
    assert g[1].response == "A" and g[1].correct and g[1].category == "A"          # K1
    assert g[2].category == "MULTI" and not g[2].is_valid and not g[2].correct
    assert g[3].category == "HALL / NONE"
    assert g[4].category is None and g[4].correct is False                          # K4
    assert g[5].category == "CHECK" and g[5].valid is None
    assert g[6].response is None
    raw = {r.case_id: r for r in G.grade(df, normalize=False).collect()}
    assert not raw[1].is_valid                                                      # legacy rule of K1


def test_plurality_vote_ties_and_empty(spark):
    rows = [("k1", r) for r in ["A", "A", "B"]] + [("k2", r) for r in ["A", "B", "HALL", "HALL", "B"]] + [("k3", None), ("k3", None)]
    df = spark.createDataFrame(rows, "k string, response string")
    v = {r.k: r for r in S.plurality_vote(df, ["k"]).collect()}
    assert (v["k1"].vote, v["k1"].n_vote, v["k1"].tie) == ("A", 2, False)
    assert v["k2"].vote is None and v["k2"].n_vote is None and v["k2"].tie            # K5 tie -> NaN
    assert (v["k3"].vote, v["k3"].n_vote) == (None, 0)                               # no answers -> (None, 0)
    m = {r.k: r for r in S.plurality_vote(df, ["k"], identify_majority=False).collect()}
    assert m["k2"].n_vote == 2


def test_consistency_denominator(spark):
    df = spark.createDataFrame([("g", 1, "A"), ("g", 1, "A"), ("g", 1, "B")], "g string, case_id long, response string")
    e = S.consistency(df, ["g"]).first()
    o = S.consistency(df, ["g"], denominator="observed").first()
    assert e.consistency == pytest.approx(0.2) and o.consistency == pytest.approx(2 / 3)   # K6


def test_heatmap_buckets_small_counts(spark):
    cases = spark.createDataFrame([("g", 1, 2, 0), ("g", 2, 10, 10), ("g", 3, None, 4)], "g string, case_id long, n_vote long, n_correct long")
    h = S.consistency_correctness_heatmap(cases, ["g"]).collect()
    assert {(r.bucket, r.n_correct): r.n for r in h if r.n} == {(7, 0): 1, (10, 10): 1} and len(h) == 44   # K7; ties are left out


def test_case_summary(spark):
    rows = [("g", 1, "A", True)] * 3 + [("g", 1, "B", False), ("g", 2, "A", False), ("g", 2, "C", True), ("g", 2, None, False), ("g", 3, None, False)]
    got = {r.case_id: (r.n_correct, r.n_runs, r.top_n, r.tie, r.n_vote) for r in S.case_summary(spark.createDataFrame(rows, "g string, case_id long, response string, correct boolean"), ["g"]).collect()}
    assert got == {1: (3, 4, 3, False, 3), 2: (1, 3, 1, True, None), 3: (0, 1, 0, False, 0)}


@pytest.mark.parametrize("ids", ["sparse", "crowded", "text"])
def test_order_rank_on_any_keys(spark, ids):
    """No window holds more than a small share of the rows, whatever the keys look like; ranks are those of a plain sort."""
    make = {"sparse": lambda i: (i * 2654435761 % 2 ** 31) ** 2, "crowded": lambda i: i if i % 10 else 10 ** 15 + i, "text": lambda i: hashlib.md5(str(i).encode()).hexdigest()}[ids]
    rows = [("a" if i % 4 else None, int(i % 3 == 0), make(i)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "g string, v int, id " + ("string" if ids == "text" else "long")).repartition(5)
    got = order_rank(df, ["g"], ["v", "id"]).collect()
    for g in ("a", None):
        want = sorted((v, i) for k, v, i in rows if k == g)
        assert [(r.v, r.id) for r in sorted((r for r in got if r.g == g), key=lambda r: r.position)] == want
        assert sorted(r.position for r in got if r.g == g) == list(range(1, len(want) + 1))
    assert with_bucket(df, ["v", "id"]).groupBy("_bk").count().agg(F.max("count")).first()[0] < 0.02 * len(rows)
    plan = order_rank(df, ["g"], ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") >= 2 and "windowspecdefinition(id" not in plan


def test_exact_percentiles_equal_percentile(spark):
    rng = np.random.default_rng(7)
    values = [("x", float(v)) for v in rng.lognormal(0, 3, 30_000)] + [("y", float(v)) for v in rng.integers(0, 4, 5000)] + [(None, 1.5), ("z", None)] + \
        [("w", float(v)) for v in rng.normal(size=2)] + [("x", 0.25)] * 9000
    df = spark.createDataFrame(values, "k string, v double").repartition(6)
    qs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = {r.k: tuple(r)[1:] for r in S.exact_percentiles(df, ["k"], "v", qs).collect()}
    want = {r.k: tuple(r)[1:] for r in df.where("v IS NOT NULL").groupBy("k").agg(*[F.percentile("v", q) for q in qs]).collect()}
    assert got == want
    d = {r.k: r for r in S.describe_continuous(df, ["k"], "v").collect()}
    assert d["z"].missing == 1 and d["z"].median is None and d["x"].median == want["x"][3]


def test_completeness_lists_missing_and_unexpected(spark):
    r = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 9), ("b", 9)], "s string, case_id long")
    u = spark.createDataFrame([(1,), (2,), (3,), (3,)], "case_id long")
    got = sorted(tuple(x) for x in G.completeness_check(r, u, ["s"]).collect())
    assert got == [("a", 3, "missing"), ("b", 2, "missing"), ("b", 3, "missing"), ("b", 9, "unexpected")]


def test_box_stats_one_pass(spark):
    v = [1, 2, 2, 3, 3, 3, 4, 4, 5, 30]
    r = S.box_stats(spark.createDataFrame([("g", float(x)) for x in v] + [("g", None)], "g string, v double"), ["g"], "v").first()
    q1, med, q3 = np.percentile(v, [25, 50, 75])
    assert (r.q1, r["median"], r.q3, r.n, r.whisker_low, r.whisker_high, r.n_outliers) == (q1, med, q3, 10, 1, 5, 1)


def test_gate_decides_what_is_described(spark):
    rows = [(c, m, e, "k", float(1 + (c * (1 if e == "u1" or agree else 3)) % 5)) for agree in (True,) for c in range(40) for m in ("m0",) for e in ("u1", "u2")]
    r = spark.createDataFrame(rows, "case_id long, model string, evaluator string, metric string, score double")
    for kappa, raters in ((0.9, {"average_user1_user2"}), (0.5, {"u1", "u2"})):
        gate = spark.createDataFrame([("m0", kappa)], "model string, quadratic_weighted_kappa double")
        d = S.describe(A.gated_average(r, gate), ["evaluator", "model", "metric"], "score").collect()
        assert {x.evaluator for x in d} == raters and all(x.n == 40 for x in d)


def test_hash_rank_numbers_every_group_in_hash_order(spark):
    """Any key distribution: one group holds nearly all rows, and its keys are heavily skewed."""
    rows = [("a" if i % 50 else "b", 2 ** (i % 40) * 1000 + i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = hash_rank(df, ["g"], ["v"], salt="s").collect()
    for g in ("a", "b"):
        mine = sorted((r.idx, r.v) for r in got if r.g == g)
        want = sorted((v for k, v in rows if k == g), key=lambda v: hashlib.md5(f"s|{g}|{v}".encode()).hexdigest())
        assert [v for _, v in mine] == want and [i for i, _ in mine] == list(range(len(want)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 120, 121, 122, 1000, 4097])
def test_bijection_of_every_size(spark, n):
    df = spark.range(n).crossJoin(spark.range(3).withColumnRenamed("id", "g")).withColumn("n", F.lit(n).cast("long"))
    got = bijection(df, "id", "n", ["g"], 5, "to").collect()
    for g in range(3):
        assert sorted(r.to for r in got if r.g == g) == list(range(n))
    if n >= 120:
        images = [tuple(r.to for r in sorted(got, key=lambda r: r.id) if r.g == g) for g in range(3)]
        assert len(set(images)) == 3 and all(sum(a == b for a, b in zip(x, y)) < 12 for x in images for y in images if x is not y)


def test_bijection_spreads_neighbours_evenly(spark):
    """Over 400 keys, where a number and its neighbour go is uniform, alone and together (chi-square, 99.99 % point)."""
    n, groups = 101, 400 * 25
    df = spark.range(groups).select(F.col("id").alias("g"), F.explode(F.array(F.lit(40).cast("long"), F.lit(41).cast("long"))).alias("x"), F.lit(n).cast("long").alias("n"))
    rows = bijection(df, "x", "n", ["g"], 1, "to").groupBy("g").agg(F.max(F.when(F.col("x") == 40, F.col("to"))).alias("p"), F.max(F.when(F.col("x") == 41, F.col("to"))).alias("q")).collect()
    alone, together = np.zeros(n), np.zeros(n)
    for r in rows:
        alone[r.p] += 1
        together[(r.p - r.q) % n] += 1
    assert together[0] == 0
    assert ((alone - groups / n) ** 2 / (groups / n)).sum() < 160
    assert ((together[1:] - groups / (n - 1)) ** 2 / (groups / (n - 1))).sum() < 160


def test_permutation_preserves_run_label_counts(spark):
    rows = [("m", r, 7 * c * c, "ABCDE"[(c * r) % 5]) for r in (1, 2, 3) for c in range(200) if (r, c) != (2, 9)]
    df = spark.createDataFrame(rows, "model string, run int, case_id long, response string")
    p = R.permute_within(df, ["model", "run"], "case_id", "response", seed=9)
    before = sorted(df.groupBy("run", "response").count().collect())
    after = sorted(p.groupBy("run", "response").count().collect())
    assert before == after and p.count() == df.count()
    assert p.select("run", "no").distinct().count() == 599 and p.agg(F.min("no"), F.max("no")).first()[:] == (0, 199)
    numbers = {r.case_id: r.no for r in R.unit_numbers(df.select("case_id").distinct(), "case_id").collect()}
    both = R.permute_within(df, ["model", "run"], "case_id", "response", seed=9, observed=True).collect()
    assert sorted((r.run, r.no, r.response) for r in both if r.side == "a") == sorted((r, numbers[c], x) for _, r, c, x in rows)
    assert sorted((r.run, r.no, r.response) for r in both if r.side == "b") == sorted((r.run, r.no, r.response) for r in p.collect())


def test_permuted_consistency_agrees_with_plain_permutation(spark):
    """Ten runs of the same skewed answers: the mean consistency after permuting is that of independent shuffles."""
    rng = np.random.default_rng(2)
    answers = rng.choice(list("ABCDE"), 1500, p=[.45, .25, .15, .1, .05])
    rows = [("m", r, c, str(answers[c])) for r in range(10) for c in range(1500)]
    df = spark.createDataFrame(rows, "model string, run int, case_id long, response string")
    got = S.mean_consistency(S.consistency(R.permute_within(df, ["model", "run"], "case_id", "response", 3), ["model"], case_key="no"), ["model"]).first().mean_consistency
    plain = []
    for _ in range(60):
        m = np.array([rng.permutation(answers) for _ in range(10)])
        plain.append(np.mean([max((m[:, c] == x).sum() for x in "ABCDE") / 10 for c in range(1500)]))
    assert abs(got - np.mean(plain)) < 5 * np.std(plain)


@pytest.mark.parametrize("at_once", [2, 65536])
def test_bootstrap_exact_matches_bruteforce(spark, monkeypatch, at_once):
    monkeypatch.setattr(R, "DRAWS", at_once)
    vals = [0.1, 0.5, 0.2, 0.9, 0.4]
    df = spark.createDataFrame([("g", i + 1, v) for i, v in enumerate(vals)], "k string, idx long, v double")
    B, seed = 200, 11
    out = R.bootstrap_exact(df, ["k"], "v", B, seed, index="idx").first()

    def u(b, j):
        h = hashlib.md5(f"{seed}|g|{b}|{j}".encode()).hexdigest()
        return int(h[:13], 16) / 2.0 ** 52
    means = [np.mean([vals[int(u(b, j) * 5)] for j in range(1, 6)]) for b in range(B)]
    assert out.ci_low == pytest.approx(np.percentile(means, 2.5))
    assert out.ci_high == pytest.approx(np.percentile(means, 97.5))
    assert out.estimate == pytest.approx(np.mean(vals))
    assert "md5" in uniform_sql("1", "b")


def test_bootstrap_hist_close_to_bruteforce(spark):
    rng = np.random.default_rng(0)
    vals = rng.integers(0, 11, 400) / 10.0
    df = spark.createDataFrame([("g", float(v)) for v in vals], "k string, v double")
    out = R.bootstrap_hist(df, ["k"], "v", 4000, 5).first()
    boot = [rng.choice(vals, len(vals)).mean() for _ in range(4000)]
    lo, hi = np.percentile(boot, [2.5, 97.5])
    se = vals.std() / np.sqrt(len(vals))
    assert abs(out.ci_low - lo) < 0.25 * se and abs(out.ci_high - hi) < 0.25 * se
    assert out.n_boot == 4000


def test_bootstrap_median_hist(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [0, 0, 1, 1, 1, 2, -1, 0, 1, 1]], "k string, d double")
    out = R.bootstrap_hist(df, ["k"], "d", 500, 1, stat="median").first()
    assert out.estimate == pytest.approx(1.0) and -1 <= out.ci_low <= out.ci_high <= 2


XML = ('<article><front><article-meta><article-id pub-id-type="pmid">77</article-id><article-id pub-id-type="pmc">5</article-id>'
       '<article-title> T </article-title></article-meta><license license-type="cc-by"><ext-link ext-link-type="uri" '
       'xlink:href="http://x/y">l</ext-link></license><copyright-statement> (c) me </copyright-statement></front>'
       '<body><p>Intro one [<xref>1</xref>, <xref>2</xref>] end</p><sec id="s1"><title>Methods</title><p>m1</p>'
       '<sec id="s1a"><title>Sub</title><p>deep</p></sec></sec><p>after</p><sec id="s2"><p>no title</p></sec>'
       '<sec id="s1"><title>Methods</title><p>again</p></sec><fig><caption>fig text</caption></fig>'
       '<sec id="s3"><title>Résults</title><p>r  x</p></sec></body></article>')


def test_article_sections_and_metadata(spark):
    df = spark.createDataFrame([("pmc", 2020, 1, XML)], "db string, year int, doc_id long, xml string")
    secs = {(r.portion, r.title): r.text for r in C.article_sections(C.article_elements(df)).collect()}
    assert secs[("body", "Introduction")] == "Intro one end"                          # X1 + default title
    assert secs[("body", "Methods")] == "m1 Sub deep after no title again"             # inheritance + same-title join
    assert ("body", "Résults") in secs and secs[("body", "Résults")] == "r x"
    assert all("fig text" not in t for t in secs.values())                             # X9
    m = C.article_metadata(df).first()
    assert (m.pmid, m.pmc, m.article_title, m.license_type, m.license_url, m.copyright_text) == (
        "77", "5", "T", "cc-by", "http://x/y", "(c) me")
    inv = C.sections_map(C.section_inventory(df)).first().body_sections
    assert inv["s1"] == "Methods" and inv["blank"] == "blank" and inv["s2"] == "N/A"   # K20 last wins


def test_normalize_text_nfkd(spark):
    df = spark.createDataFrame([("ﬁ  café\t\n x ",)], "t string")
    out = df.select(C.normalize_text(F.col("t")).alias("n")).first().n
    assert out == "fi café x"


def test_strip_option_letters(spark):
    df = spark.createDataFrame([("A. alpha; B. beta; C. gamma; D. delta; E. epsilon.",)], "o string")
    assert df.select(P.strip_option_letters(F.col("o")).alias("s")).first().s == "alpha; beta; gamma; delta; epsilon"


def test_upsert_latest(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, seq int, text string")
    got = {r.key: r.text for r in P.upsert_latest(df, ["key"], "seq").collect()}
    assert got == {"k": "new", "j": "only"}


def test_article_walk_keeps_tails_nested_sections_and_errors(spark):
    docs = [("pmc", 2020, 1, '<article><body><p>before <fig>f</fig>after the figure</p><sec id="a"><title>T</title>tail<sec id="b"><p>x</p></sec></sec></body></article>'),
            ("pmc", 2020, 2, "<article><body><p>a&nbsp;b note:alpha … a:b</p></body></article>"),
            ("pmc", 2020, 3, "<article><body><p>open<br></p></body></article>"), ("pmc", 2020, 4, None)]
    df = spark.createDataFrame(docs, "db string, year int, doc_id long, xml string")
    got = C.article_elements(df).collect()
    texts = {(r.doc_id, r.position): r.text for r in got if r.parse_error is None}
    assert texts[1, 0] == "before after the figure" and texts[1, 1] == "tail x" and texts[2, 0] == "a b note:alpha … a:b".replace("…", "...")
    assert {r.doc_id for r in got if r.parse_error} == {3, 4} and {r.doc_id for r in C.article_metadata(df).where("parse_error IS NOT NULL").collect()} == {3, 4}
    inv = [(r.sec_id, r.title) for r in C.section_inventory(df).where("doc_id = 1").orderBy("position").collect()]
    assert inv == [("a", "T"), ("b", "N/A"), ("blank", "blank")]


def test_wrong_case_without_judgement_reaches_hall_none(spark):
    j = spark.createDataFrame([(1, "m", "v", 1, 1, 3.0), (1, "m", "v", 2, 1, 4.0)], "case_id long, model string, variant string, truth_position int, preferred int, agreement double")
    g = spark.createDataFrame([(1, "m", "v", False), (2, "m", "v", False)], "case_id long, model string, variant string, correct boolean")
    out = {r.outcome: r.n for r in J.judge_outcomes(J.judge_filter(J.judge_joined(j, g))).collect()}
    assert out["hall_none"] == 1 and sum(out.values()) == 2


def test_long_keys_stay_apart(spark):
    df = spark.createDataFrame([(123456789, 1, "a"), (123456780, 1, "b")], "conv_id long, turn int, answer string")
    got = P.upsert_latest(df.withColumn("case_key", F.col("conv_id").cast("string")), ["case_key"], "turn")
    assert got.count() == 2


def test_likert_levels_between_whole_points(spark):
    from gradebook.operators import summary as S
    df = spark.createDataFrame([("m", 4.5), ("m", 4.0), ("m", 6.0)], "model string, score double")
    got = {r.score: (r.n, r.percent) for r in S.likert_percent(df, ["model"]).collect()}
    assert got[4.5][0] == got[4.0][0] == got[6.0][0] == 1 and got[1.0][0] == 0 and sum(p for _, p in got.values()) == pytest.approx(100)
