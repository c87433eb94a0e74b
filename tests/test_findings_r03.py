"""Findings of round 3: work dealt by the case, no large broadcasts, whole permutations, fits on all rows."""

import bisect
import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradebook.llm import pii
from gradebook.operators import judging as J
from gradebook.operators import resample as R
from gradebook.operators import summary as S
from gradebook.operators.ranking import with_bucket
from gradebook.operators.reshape import drop_empty_columns
from gradebook.plans.catalog import load_all
from gradebook.sources import fixtures as fx

REG = load_all()


@pytest.fixture
def orders(spark, tmp_path):
    rows = [(7 * i, i % 11, f"{i % 5 + 1}-X", "O") for i in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_the_case_views_grow_with_the_cases(spark, orders, monkeypatch):
    monkeypatch.setattr(fx, "CASES_PER_TASK", 10)
    tasks = max(40, spark.sparkContext.defaultParallelism)
    for view in (fx.responses_t0, fx.responses_rep, fx.ratings, fx.judgements):
        v = view(spark, orders).withColumn("task", F.spark_partition_id())
        assert "hashpartitioning(o_orderkey#" in _plan(v) and f", {tasks})" in _plan(v)
        assert v.groupBy("case_id").agg(F.count_distinct("task").alias("n")).agg(F.max("n")).first()[0] == 1


@pytest.mark.parametrize("name", ["plurality_vote", "plurality_vote_count_max", "correct_per_case", "src_repetitions", "ratings_wide"])
def test_cases_are_grouped_without_a_shuffle_of_the_fanned_out_rows(spark, orders, name):
    plan = _plan(REG[name].run(spark, orders)).split("Subquery")[0]
    assert plan.count("Exchange") == 1


RATING_QUERIES = ["agreement_levels", "boot_median_diff", "describe_analysis", "gated_average", "global_agreement", "rater_agreement"]


@pytest.mark.parametrize("name", RATING_QUERIES)
def test_rating_queries_aggregate_by_case_in_the_tasks_of_the_view(spark, orders, monkeypatch, name):
    """Both passes (the gate and the scores behind it): as many tasks as the cases ask for, and no shuffle by the case after the fan-out."""
    monkeypatch.setattr(fx, "CASES_PER_TASK", 10)
    tasks = max(40, spark.sparkContext.defaultParallelism)
    shuffles = [x for x in _plan(REG[name].run(spark, orders)).splitlines() if "hashpartitioning(" in x]
    assert any("hashpartitioning(o_orderkey#" in x for x in shuffles)
    for x in shuffles:
        assert f", {tasks})" in x if "o_orderkey#" in x else "case_id" not in x


def test_cases_of_a_task_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "CASES_PER_TASK", 50)
    for n in (50 * 5 * spark.sparkContext.defaultParallelism, 50 * 20 * spark.sparkContext.defaultParallelism):
        spark.range(n).select(F.col("id").alias("o_orderkey"), F.lit("1-X").alias("o_orderpriority")).write.parquet(str(tmp_path / str(n) / "orders.parquet"))
        v = fx.ratings(spark, str(tmp_path / str(n))).withColumn("task", F.spark_partition_id())
        t = v.groupBy("task").agg(F.count_distinct("case_id").alias("cases"), F.count("*").alias("n")).agg(F.max("cases"), F.sum("cases"), F.max("n")).first()
        assert t[0] < 2 * 50 and t[1] == n and t[2] == 20 * t[0]


@pytest.mark.parametrize("name", ["reproducibility_report", "repro_pairs", "stratified_paired_tests", "scores_with_correctness"])
def test_no_side_that_grows_with_the_cases_is_broadcast(spark, orders, name):
    """The estimate from a small file would have these rows broadcast through the driver."""
    plan = _plan(REG[name].run(spark, orders))
    assert "SortMergeJoin [case_id" in plan or "SortMergeJoin [model" in plan
    if name in ("repro_pairs", "scores_with_correctness"):
        assert "Broadcast" not in plan


def test_permutation_by_two_orders_of_all_rows(spark):
    """Against plain sorting: repeated and null units and null values take part."""
    rows = [(g, c, v) for g in ("a", "b") for c, v in [(i, "ABC"[i % 3]) for i in range(700)] + [(3, "Z"), (5, None), (None, "N")]]
    df = spark.createDataFrame(rows, "g string, u long, v string")
    got = Counter((r.g, r.u, r.v) for r in R.permute_by_rank(df, ["g"], "u", "v", 9, 3).collect())

    def at(salt, g, u):
        return hashlib.md5("|".join(str(x) for x in (salt, g, u) if x is not None).encode()).hexdigest()

    want = Counter()
    for g in ("a", "b"):
        of = [r for r in rows if r[0] == g]
        to = sorted(of, key=lambda r: (at("unit", g, r[1]), r[1] is not None, r[1] or 0))
        source = sorted(of, key=lambda r: (at("9", g, r[1]), r[1] is not None, r[1] or 0, r[2] or ""))
        want.update((g, a[1], b[2]) for a, b in zip(to, source))
    assert got == want


def test_permuted_queries_use_both_orders(spark, orders):
    for name in ("permuted_consistency", "pooled_random_baseline"):
        assert REG[name].sql.count("ORDER BY md5") == 2 and "nm AS" not in REG[name].sql
        assert "md5" in _plan(REG[name].run(spark, orders))


def test_observed_side_is_not_shuffled(spark, orders):
    plan = _plan(REG["boot_mean_difference"].run(spark, orders))
    assert "Join" not in plan and plan.count("hashpartitioning(no#") == 1


def test_pii_fit_counts_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "boost", lambda cells: seen.append(sum(c[1] for c in cells)) or (0.0, []))
    monkeypatch.setattr(pii, "calibrate", lambda model, cells: seen.append(sum(c[1] for c in cells)) or float("inf"))
    docs = spark.range(33_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("call +49 30 1234"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    per_doc = docs.limit(1).select("doc_id", "text")
    one = pii.with_matches(per_doc).select(F.size("number")).first()[0]
    pii.fit(docs)
    assert one > 0 and sum(seen) == 33_000 * one


def test_votes_and_summary_of_ties_nulls_and_no_answers(spark):
    rows = [("g", 1, x) for x in ("B", "A", "B", "A", None)] + [("g", 2, x) for x in ("C", "C", "A")] + [("g", 3, None), ("g", None, "E")]
    df = spark.createDataFrame(rows, "g string, case_id long, response string")
    got = {r.case_id: tuple(r)[2:] for r in S.plurality_vote(df, ["g", "case_id"]).collect()}
    assert got == {1: (4, True, None, None), 2: (3, False, "C", 2), 3: (0, False, None, 0), None: (1, False, "E", 1)}
    got = {r.case_id: (r.n_answers, r.tie, r.vote, r.n_vote) for r in S.plurality_vote(df, ["g", "case_id"], identify_majority=False).collect()}
    assert got[1] == (4, True, None, 2)
    assert S.plurality_vote(df, ["g", "case_id"]).columns == ["g", "case_id", "n_answers", "tie", "vote", "n_vote"]
    got = {r.case_id: tuple(r)[2:] for r in S.case_summary(df.withColumn("correct", F.lit(True)), ["g"]).collect()}
    assert got[1] == (5, 5, 2, True, None) and got[3] == (1, 1, 0, False, 0)


@pytest.mark.parametrize("cuts", [1, 2, 5, 31, 1024])
def test_buckets_by_binary_search(spark, cuts):
    rng = random.Random(cuts)
    values = [rng.randrange(300) for _ in range(900)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    pts = sorted((r.h, r.v) for r in df.select(F.xxhash64("v").alias("h"), "v").collect())[:cuts]
    pts = sorted(v for _, v in pts)
    assert all(r._bk == bisect.bisect_right(pts, r.v) for r in with_bucket(df, ["v"], cuts).collect())


def test_empty_columns_are_told_by_all_rows(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") == 1999, F.lit("x")).alias("late"), F.when(F.col("id") < 0, 1).alias("none"), F.lit(None).cast("string").alias("void"))
    out = drop_empty_columns(df)
    assert out.columns == ["id", "late"] and out.count() == 2000
    assert drop_empty_columns(df, keep=["void"]).columns == ["id", "late", "void"]
    assert drop_empty_columns(df.where("id < 0")).columns == []


@pytest.mark.parametrize("name", ["judge_agreement_levels", "judge_filter"])
def test_wrong_answers_are_told_after_the_answers_are_made(spark, orders, name):
    """A Filter below the projections would repeat the response's expression; neither side of the join may be broadcast."""
    plan = _plan(REG[name].run(spark, orders))
    assert not [x for x in plan.splitlines() if "Filter" in x and "1000003" in x]
    assert "SortMergeJoin [model" in plan


def test_judged_rows_that_repeat_or_have_no_key(spark):
    j = spark.createDataFrame([("m", "v", c, t, 1, 2.0) for c in (1, 2, None) for t in (1, 2)],
                              "model string, variant string, case_id long, truth_position int, preferred int, agreement double")
    g = spark.createDataFrame([("m", "v", 1, False), ("m", "v", 1, False), ("m", "v", 1, True), ("m", "v", 3, None), ("m", "v", None, False), ("m", "x", 1, True)],
                              "model string, variant string, case_id long, correct boolean")
    got = Counter((r.case_id, r.preferred_1, r.correct) for r in J.judge_joined(j, g).collect())
    assert got == {(1, True, False): 2, (1, True, True): 1, (2, True, None): 1, (3, None, None): 1, (None, True, None): 1, (None, None, False): 1}


def test_tallies_have_one_row_unless_a_label_is_rare(spark):
    rows = [("g", 1, x) for x in ("A", "B", "C", "HALL", "NONE", "E", "D", None)] + [("g", 2, x) for x in ("A-C", "A-C", "D-E", "A")]
    df = spark.createDataFrame(rows, "g string, case_id long, response string")
    got = Counter((r.case_id, r._rare, r._top) for r in S._tallies(df, ["g", "case_id"], "response").collect())
    assert got == {(1, None, 1): 1, (2, None, 1): 1, (2, "A-C", 2): 1, (2, "D-E", 1): 1}


def test_votes_against_plain_counts(spark):
    rng = random.Random(5)
    labels = ["A", "B", "E", "HALL", "NONE", "A-C", "B-D", "zz", "", None]
    rows = [("m", c, rng.choice(labels[:rng.randrange(1, 11)][-4:])) for c in range(300) for _ in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "g string, case_id long, response string")
    n = {c: Counter(x for _, d, x in rows if d == c and x is not None) for c in {r[1] for r in rows}}
    want = {}
    for c, k in n.items():
        top = max(k.values(), default=0)
        best = [x for x in k if k[x] == top]
        want[c] = (sum(k.values()), len(best) > 1, best[0] if len(best) == 1 else None, None if len(best) > 1 else top, top)
    got = {r.case_id: (r.n_answers, r.tie, r.vote, r.n_vote) for r in S.plurality_vote(df, ["g", "case_id"]).collect()}
    assert got == {c: w[:4] for c, w in want.items()}
    got = {r.case_id: (r.n_vote, r.n_answers) for r in S.consistency(df, ["g"]).collect()}
    assert got == {c: (w[4], w[0]) for c, w in want.items()}


def test_case_summary_and_heatmap_against_plain_counts(spark):
    """Ties among rare labels, of rare and known ones, of known ones; nulls alone; null, NaN and repeated keys."""
    rng = random.Random(7)
    labels = ["A", "B", "E", "HALL", "NONE", "A-C", "B-D", "zz", "", None]
    rows = [(t, c, rng.choice(labels[:rng.randrange(1, 11)][-4:]), rng.random() < 0.5) for t in (0.3, 1.0, None, math.nan) for c in [*range(150), None]
            for _ in range(rng.randrange(1, 11))]
    df = spark.createDataFrame(rows, "g double, case_id long, response string, correct boolean")
    name = lambda g: "nan" if g is not None and g != g else g
    groups = {}
    for g, c, x, ok in rows:
        groups.setdefault((name(g), c), []).append((x, ok))
    want, cells = {}, Counter()
    for (g, c), rs in groups.items():
        k = Counter(x for x, _ in rs if x is not None)
        top = max(k.values(), default=0)
        tie, ok = sum(n == top for n in k.values()) > 1, sum(ok for _, ok in rs)
        want[g, c] = (ok, len(rs), top, tie, None if tie else top)
        if not tie:
            cells[g, max(top, 7), ok] += 1
    cases = S.case_summary(df, ["g"])
    assert cases.columns == ["g", "case_id", "n_correct", "n_runs", "top_n", "tie", "n_vote"]
    assert {(name(r.g), r.case_id): tuple(r)[2:] for r in cases.collect()} == want
    got = S.consistency_correctness_heatmap(cases, ["g"]).collect()
    assert len(got) == 4 * 44 and {(name(r.g), r.bucket, r.n_correct): r.n for r in got if r.n} == cells


@pytest.mark.parametrize("name", ["consistency_correctness_heatmap", "always_correct_or_wrong"])
def test_case_summaries_are_not_sorted(spark, orders, name):
    """The only sort left is that of the cases, ahead of their fan-out."""
    plan = _plan(REG[name].run(spark, orders))
    assert "SortAggregate" not in plan and plan.count("Sort [") == 1


def test_answers_by_lookup(spark):
    """The answer of each code, model and truth number, missing ones too, against the rule; its code stands in it once."""
    rows = [(code, mid, tk) for code in [*range(20), None] for mid in range(6) for tk in [*range(5), None]]
    df = spark.createDataFrame(rows, "code long, mid int, tk int")
    out = df.select("code", "mid", "tk", fx._response(F.col("code"), F.col("tk"), F.col("mid")).alias("r"))

    def rule(code, mid, tk):
        if code is None or code > 16:
            return {17: "HALL", 18: "A-C"}.get(code, "NONE")
        return "E" if tk is None else "ABCDE"[tk if code < mid + 6 else (tk + 1 + code) % 5]

    assert [r.r for r in out.collect()] == [rule(*x) for x in rows]
    assert str(fx._response(F.col("the_code"), F.col("tk"), F.col("mid"))).count("the_code") == 1
