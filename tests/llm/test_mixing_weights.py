"""op8: the stated weights hold to less than one block at any length, and many sources and slots are scheduled."""

import math
import time
from fractions import Fraction

from pyspark.sql import functions as F

from gradebook.llm import mixing


def test_deviation_from_the_stated_square_roots(spark):
    """Weights that thousandths would miss: about 29,000 blocks, deviation from sqrt(rows) as floored, under one block at every slot."""
    sizes = {"a": 160_000, "b": 40_007, "c": 20_011, "d": 9_999}
    docs = spark.range(sum(sizes.values())).withColumn("doc_id", F.col("id"))
    steps, low = F.lit(None).cast("string"), 0
    for s, n in sizes.items():
        steps = F.when((F.col("id") >= low) & (F.col("id") < low + n), F.lit(s)).otherwise(steps)
        low += n
    rows = mixing.mix_sources(docs.select("doc_id", steps.alias("source"))).where("in_mix").select("source", "slot", "units").distinct().collect()
    weight = {s: math.isqrt(n) for s, n in sizes.items()}
    assert {(r["source"], r["units"]) for r in rows} == set(weight.items())
    at = {r["slot"]: r["source"] for r in rows}
    done, total = dict.fromkeys(sizes, 0), sum(weight.values())
    for t in range(max(at) + 1):
        done[at[t]] += 1
        assert all(abs(done[s] - Fraction(weight[s] * (t + 1), total)) < 1 for s in sizes)
    assert len(at) > 3 * total


def test_a_long_period_and_many_sources(spark):
    """20,000 slots of unequal weights, and 2,000 sources."""
    weights = {"s0": 12_345, "s1": 7_001, "s2": 654}
    start = time.time()
    slots = mixing.period(mixing.units(spark.range(300).selectExpr("id AS doc_id", "concat('s', id % 3) AS source"), weights)).collect()
    assert time.time() - start < 60
    assert sorted(r["__mix_slot"] for r in slots) == list(range(20_000))
    for r in slots:
        k, a = r["__mix_k"], r["__mix_a"]
        assert k * 20_000 // a <= r["__mix_slot"] < -(-(k + 1) * 20_000 // a)
    many = mixing.mix_sources(spark.range(6_000).selectExpr("id AS doc_id", "concat('s', id % 2000) AS source")).select("slot", "units", "block", "release", "deadline").collect()
    assert len(many) == 6_000 and all(r["release"] <= r["slot"] < r["deadline"] for r in many) and {r["units"] for r in many} == {1}
