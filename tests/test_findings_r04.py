"""Findings of round 4: permutations in passes over the sheets, ranks from one evaluation, cheap significant digits."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradebook.operators import resample as R
from gradebook.plans import q_resample as Q
from gradebook.plans.catalog import load_all, significant
from gradebook.session import CLEANUP, checkpoint_dir, shuffles_dropped
from gradebook.sources import fixtures as fx
from gradebook.sources import readers as RD

REG = load_all()


@pytest.fixture
def orders(spark, tmp_path):
    rows = [(7 * i, i % 11, f"{i % 5 + 1}-X", "O") for i in range(120)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_some_sheets_of_the_view_are_those_of_the_whole(spark, orders):
    whole = fx.responses_rep(spark, orders)
    part = fx.responses_rep(spark, orders, only=([0.6], ["m1", "m4"]))
    assert _rows(part) == _rows(whole.where("temperature = 0.6 AND model IN ('m1', 'm4')")) and part.count() == 120 * 2 * 10


def test_passes_hold_each_sheet_once(spark, orders, monkeypatch):
    temps, models = fx.SHEETS
    for most, n in ((21_600, 1), (21_599, 3), (7_199, 6), (3_599, 18), (1, 18)):
        monkeypatch.setattr(Q, "PASS_ROWS", most)
        passes = Q.sheet_passes(spark, orders)
        assert len(passes) == n and Counter((t, m) for ts, ms in passes for t in ts for m in ms) == Counter((t, m) for t in temps for m in models)


@pytest.mark.parametrize("name", ["permuted_consistency", "pooled_random_baseline", "boot_mean_difference", "observed_vs_random"])
def test_permutations_in_passes_give_the_same(spark, orders, monkeypatch, name):
    one = _rows(REG[name].run(spark, orders))
    monkeypatch.setattr(Q, "PASS_ROWS", 1)
    many = REG[name].run(spark, orders)
    assert _rows(many) == one
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "passes-" in plan and "orders.parquet" not in plan   # the passes have been written


def test_shuffles_of_a_pass_are_dropped(spark):
    def shuffles():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}

    path = os.path.join(checkpoint_dir(spark), "dropped")
    before = shuffles()
    with shuffles_dropped(spark):
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.mode("overwrite").parquet(path)
    assert shuffles() <= before and spark.conf.get(CLEANUP, None) in (None, "false")
    assert spark.read.parquet(path).count() == 7


def test_rank_permutation_shuffles_rows_once_by_each_key(spark):
    """A group key with a fraction (the temperature) doesn't make Spark deal the rows out a second time."""
    df = spark.range(100).select((F.col("id") % 3 / 10).alias("t"), F.lit("m").alias("m"), F.col("id").alias("u"), F.lit("A").alias("v"))
    plan = R.permute_by_rank(df, ["t", "m"], "u", "v", 5, 3)._jdf.queryExecution().executedPlan().toString()
    behind = plan[plan.index("Window [row_number() windowspecdefinition(_w#"):]
    assert "REPARTITION_BY_NUM" in next(x for x in behind.splitlines() if "Exchange hashpartitioning" in x)


def test_case_order_works_out_the_cases_once(spark, orders):
    df = REG["case_order"].run(spark, orders)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "per-case-" in plan and "orders.parquet" not in plan
    by = {}
    for r in df.collect():
        by.setdefault((r.temperature, r.model), []).append((r.position, r.n_correct, r.case_id))
    assert len(by) == 18
    for rows in by.values():
        assert [r[0] for r in sorted(rows)] == list(range(1, 121)) and [r[1:] for r in sorted(rows)] == sorted(r[1:] for r in rows)


NUMBERS = [0.3, 0.6, 1.0, 0.0, -0.0, -2.5, 1 / 3, 2 / 3, 1e-7, 1.5e-6, 0.000001, 999.999999, 999.9999995, 123456.789012, 1e15, 123456789.0, 1234567891.0, -0.1234565,
           5e-324, 1.7e308, float("inf"), float("-inf"), float("nan"), None, 0.1 + 0.2, 37.123456, 37.1234565]


def test_significant_digits_without_texts_for_short_numbers(spark):
    """The same numbers as by the text in nine digits, which is made only where a number has more."""
    out = significant(spark.createDataFrame([(x,) for x in NUMBERS], "x double"))
    assert "rint" in out._jdf.queryExecution().optimizedPlan().toString().lower()
    same = lambda a, b: a is b is None or a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    for got, x in zip((r.x for r in out.collect()), NUMBERS):
        assert same(got, x if x is None else spark.sql(f"SELECT CAST(format_string('%.8e', CAST('{x!r}' AS DOUBLE) + 0.0D) AS DOUBLE) AS x").first().x), x


def test_repetitions_compare_run_numbers(spark, orders):
    df = REG["src_repetitions"].run(spark, orders)
    assert "concat(run" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(df.select("case_id", "model", "temperature", "run", "response")) == _rows(fx.responses_rep(spark, orders).select("case_id", "model", "temperature", "run", "response"))


def test_repetition_sheets_carry_run_numbers(spark, tmp_path):
    d = tmp_path / "temperature=0.3" / "model=m0"
    d.mkdir(parents=True)
    (d / "a.csv").write_text("1,A,,C\n,B,A-C,\n")
    df = RD.read_repetition_sheets(spark, str(tmp_path), runs=3)
    assert df.dtypes == [("case_id", "bigint"), ("temperature", "double"), ("model", "string"), ("run", "int"), ("response", "string")]
    assert _rows(df) == Counter([(1, 0.3, "m0", 1, "A"), (1, 0.3, "m0", 2, None), (1, 0.3, "m0", 3, "C"), (None, 0.3, "m0", 1, "B"), (None, 0.3, "m0", 2, "A-C"), (None, 0.3, "m0", 3, None)])
    assert "substr" not in df._jdf.queryExecution().optimizedPlan().toString()
