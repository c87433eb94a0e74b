"""Self-evaluation judgements.

A judge sees the reference explanation and the model's own explanation, in two orders (truth in
position 1 or 2).  Per (model, variant, case) the two orders are aligned by one conditional
aggregate (a single shuffle on the case key) instead of two outer joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Outcome labels of the two-order judgement (never / second / first / both).
OUTCOMES = ("hall_none", "never", "second", "first", "both")


def judge_recode(j: DataFrame) -> DataFrame:
    """preferred == truth_position -> true, == the other position -> false, else NULL."""
    other = 3 - F.col("truth_position")
    pref = F.when(F.col("preferred") == F.col("truth_position"), True).when(F.col("preferred") == other, False)
    return j.withColumn("prefers_truth", pref)


def judge_joined(j: DataFrame, graded: DataFrame, keys: Sequence[str] = ("model", "variant")) -> DataFrame:
    """Both orders side by side + the model's correctness under that variant, aligned from both sides: within the judged
    (model, variant) groups a graded case without any judgement stays, with NULL preferences.

    Graded rows are counted by case and unfolded again, so that a Filter on ``correct`` isn't pushed below their projections, which would
    work the response out anew for each place it stands in.  Both sides grow with the cases: they are merged, not broadcast."""
    keys = list(keys)
    r = judge_recode(j)
    wide = r.groupBy(*keys, "case_id").agg(
        F.max(F.when(F.col("truth_position") == 1, F.col("prefers_truth").cast("int"))).alias("_p1"),
        F.max(F.when(F.col("truth_position") == 2, F.col("prefers_truth").cast("int"))).alias("_p2"),
        F.max(F.when(F.col("truth_position") == 1, F.col("agreement"))).alias("agreement_1"),
        F.max(F.when(F.col("truth_position") == 2, F.col("agreement"))).alias("agreement_2"),
    ).select(*keys, "case_id", (F.col("_p1") == 1).alias("preferred_1"), (F.col("_p2") == 1).alias("preferred_2"),
             "agreement_1", "agreement_2")
    judged = graded.select(*keys, "case_id", "correct").join(j.select(*keys).distinct(), keys, "left_semi")
    c = F.col("correct")
    marks = [(True, F.count_if(c)), (False, F.count_if(~c)), (None, F.count_if(c.isNull()))]
    judged = judged.groupBy("case_id", *keys).agg(*[n.cast("int").alias(f"_n{i}") for i, (_, n) in enumerate(marks)])
    rows = F.concat(*[F.array_repeat(F.lit(m).cast("boolean"), F.col(f"_n{i}")) for i, (m, _) in enumerate(marks)])
    return wide.join(judged.select(*keys, "case_id", F.explode(rows).alias("correct")).hint("merge"), [*keys, "case_id"], "full")


def judge_filter(joined: DataFrame) -> DataFrame:
    """Wrong answers only; ``kept`` = both orders answered."""
    wrong = joined.filter(~F.coalesce(F.col("correct"), F.lit(True)))
    return wrong.withColumn("kept", F.col("preferred_1").isNotNull() & F.col("preferred_2").isNotNull())


def _outcome() -> F.Column:
    p1, p2 = F.col("preferred_1"), F.col("preferred_2")
    return (F.when(~F.col("kept"), "hall_none").when(~p1 & ~p2, "never").when(~p1 & p2, "second")
            .when(p1 & ~p2, "first").otherwise("both"))


def judge_outcomes(filtered: DataFrame, keys: Sequence[str] = ("model", "variant")) -> DataFrame:
    """A31 (K21): counts of the five outcomes, zero included, and their percent of the group: one aggregate, unfolded to rows."""
    keys = list(keys)
    c = filtered.withColumn("outcome", _outcome()).groupBy(*keys).agg(F.count("*").alias("_t"), *[F.count_if(F.col("outcome") == o).alias(f"_{o}") for o in OUTCOMES])
    rows = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"_{o}").alias("n"), (F.col(f"_{o}") * 100.0 / F.col("_t")).alias("percent")) for o in OUTCOMES])
    return c.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def judge_agreement_levels(filtered: DataFrame, keys: Sequence[str] = ("model", "variant")) -> DataFrame:
    """Per outcome, distribution of the mean of the two agreement levels (NULLs skipped)."""
    keys = list(keys)
    a1, a2 = F.col("agreement_1"), F.col("agreement_2")
    mean2 = (F.when(a1.isNotNull() & a2.isNotNull(), (a1 + a2) / 2.0).when(a1.isNotNull(), a1).otherwise(a2))
    k = filtered.filter("kept").withColumn("outcome", _outcome()).withColumn("level", mean2)
    return k.groupBy(*keys, "outcome").agg(
        F.count("level").alias("n"), F.avg("level").alias("mean"), F.percentile("level", 0.5).alias("median"),
        F.percentile("level", 0.25).alias("q1"), F.percentile("level", 0.75).alias("q3"))
