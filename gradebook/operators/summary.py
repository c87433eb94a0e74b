"""Group summaries over the graded fact table.

All are ``groupBy`` aggregations with map-side partial aggregation; per-case work is keyed by
(group, case) so a hot group is combined before the shuffle and never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import Z_975, wilson_sql
from ..functions.text import CATEGORY_HALL_NONE, CATEGORY_MULTI, HALL_NONE, OPTIONS
from .ranking import CUTS, order_rank, with_bucket

# The distribution's always-present columns (sheet labels) in display order.
DISTRIBUTION_LABELS = ("CHECK", CATEGORY_MULTI, CATEGORY_HALL_NONE) + OPTIONS
SHEET_LABELS = OPTIONS + HALL_NONE
_SIDE = [f"_n{i}" for i in range(len(SHEET_LABELS))]   # their counts, beside each other in a vote; other labels are counted in rows of their own
_DIST_COLS = {"CHECK": "n_check", CATEGORY_MULTI: "n_multi", CATEGORY_HALL_NONE: "n_hall_none",
              **{o: f"n_{o.lower()}" for o in OPTIONS}}


def response_distribution(graded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide, zero-filled category counts per sheet; other labels in ``n_other``; NULL cells in ``n_missing``."""
    aggs = [F.count_if(F.col("category") == lab).alias(_DIST_COLS[lab]) for lab in DISTRIBUTION_LABELS]
    aggs += [
        F.count_if(~F.col("category").isin(*DISTRIBUTION_LABELS)).alias("n_other"),
        F.count_if(F.col("category").isNull()).alias("n_missing"),
        F.count("category").alias("total"),
    ]
    return graded.groupBy(*keys).agg(*aggs)


def accuracy_table(graded: DataFrame, keys: Sequence[str], n_cases: int | Column | None = None, z: float = Z_975) -> DataFrame:
    """Correct / interpretable counts and rates with Wilson bounds (proportion and count scale).

    ``n_cases`` fixes the denominator (the reference divides by the case count); default is the
    number of graded rows in the group."""
    out = graded.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if("correct").alias("n_correct"),
        F.count_if("is_valid").alias("n_interpretable"),
    )
    n = F.col("n_rows") if n_cases is None else (n_cases if isinstance(n_cases, Column) else F.lit(int(n_cases)))
    out = out.withColumn("n", n.cast("bigint"))
    lo, hi = wilson_sql("n_correct", "n", z)
    return out.withColumns({
        "acc": F.try_divide(F.col("n_correct"), F.col("n")),
        "interpretable_rate": F.try_divide(F.col("n_interpretable"), F.col("n")),
        "ci_low": F.expr(lo),
        "ci_high": F.expr(hi),
    }).withColumns({"lo_count": F.col("ci_low") * F.col("n"), "hi_count": F.col("ci_high") * F.col("n")})


def label_counts(responses: DataFrame, keys: Sequence[str], label: str = "response") -> DataFrame:
    """Count per (keys, label), NULL labels skipped (sheet cells that are empty)."""
    return responses.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"))


def _tallies(rows: DataFrame, keys: Sequence[str], label: str, *more: Column) -> DataFrame:
    """First step of the votes: answers (``_n``) and the count of each of ``SHEET_LABELS`` side by side, one row by ``keys``; any other
    label (``_rare``) has a row of its own.  ``_top``: the greatest count of a label of the row.  ``more``: further aggregates.

    NULL cells are no answers; they are left out by conditions on what is counted instead of a Filter, which Catalyst would push
    below the projection and thereby re-evaluate the label expression."""
    of, at = F.col(label), F.col("_at")
    place = F.when(of == SHEET_LABELS[0], 0)
    for i, lab in enumerate(SHEET_LABELS[1:], 1):
        place = place.when(of == lab, i)
    # the label's place is found once a row, so that the counts compare numbers
    t = rows.withColumn("_at", place).groupBy(*keys, F.when(at.isNull(), of).alias("_rare")).agg(
        F.count(of).alias("_n"), *[F.count_if(at == i).alias(c) for i, c in enumerate(_SIDE)], *more)
    return t.withColumn("_top", F.when(F.col("_rare").isNull(), F.greatest(*_SIDE)).otherwise(F.col("_n")))


def _top_counts(rows: DataFrame, keys: Sequence[str], label: str, *more: Column, also: Sequence[str] = ()) -> DataFrame:
    """(keys..., top_n, tie, also...): ``_top_votes`` without label and answers; ``also`` of ``more`` are summed.

    Plan: hash aggregates of numbers alone (a text as a result makes Spark sort): the labels that share a count are counted, then the
    greatest count and the greatest shared one are taken."""
    t, top = _tallies(rows, keys, label, *more), F.col("_top")
    sharing = sum(((F.col(c) == top).cast("int") for c in _SIDE), F.lit(0))
    t = t.withColumn("_m", F.when(F.col("_rare").isNull(), sharing).otherwise(1))
    per = t.groupBy(*keys, "_top").agg(F.sum("_m").alias("_m"), *[F.sum(c).alias(c) for c in also])
    out = per.groupBy(*keys).agg(F.max("_top").alias("top_n"), F.max(F.when((F.col("_m") > 1) & (top > 0), top)).alias("_shared"),
                                 *[F.sum(c).alias(c) for c in also])
    return out.withColumn("tie", F.coalesce(F.col("_shared") == F.col("top_n"), F.lit(False))).drop("_shared")


def _top_votes(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """(keys..., _n answers, top_n, tie, vote): the most frequent label; on a tie ``vote`` is NULL.

    Plan: ``_tallies`` with map-side partial aggregation (a hot group is combined before the shuffle), then one aggregate by keys over
    a row and one more for each rare label.  The greatest and the least label of the top count are taken; they differ on a tie."""
    t = _tallies(rows, keys, label)
    top = F.col("_top")
    first = lambda labels: F.coalesce(F.col("_rare"), *[F.when(F.col(c) == top, F.lit(lab)) for c, lab in labels])
    labels = sorted(zip(_SIDE, SHEET_LABELS), key=lambda x: x[1])
    t = t.withColumns({"_last": first(labels[::-1]), "_first": first(labels)})
    out = t.groupBy(*keys).agg(F.max(F.when(top > 0, F.struct(top.alias("n"), F.col("_last").alias("v")))).alias("_hi"),
                               F.min(F.when(top > 0, F.struct((-top).alias("n"), F.col("_first").alias("v")))).alias("_lo"),
                               F.sum("_n").alias("_n"))
    tie = F.coalesce(F.col("_hi.v") != F.col("_lo.v"), F.lit(False))
    return out.select(*keys, "_n", F.coalesce(F.col("_hi.n"), F.lit(0)).alias("top_n"), tie.alias("tie"), F.when(~tie, F.col("_hi.v")).alias("vote"))


def plurality_vote(responses: DataFrame, keys: Sequence[str], label: str = "response",
                   identify_majority: bool = True) -> DataFrame:
    """Most frequent label per group.

    Ties give vote NULL (``tie`` true); ``n_vote`` is NULL on ties when ``identify_majority`` else
    the top count.  Non-option labels (HALL, NONE, A-C) are candidates.

    The last key (the case) is compared first, as it tells most groups apart.
    """
    out = _top_votes(responses, [*reversed(list(keys))], label)
    top_n = F.col("top_n")
    return out.select(*keys, F.col("_n").alias("n_answers"), "tie", "vote", (F.when(~F.col("tie"), top_n) if identify_majority else top_n).alias("n_vote"))


def consistency(responses: DataFrame, keys: Sequence[str], case_key: str = "case_id", label: str = "response",
                denominator: str = "expected", expected_runs: int = 10) -> DataFrame:
    """Per case: top label count / runs (ties keep the count).  ``denominator='observed'`` divides by
    the answers actually present instead of ``expected_runs``."""
    # only the top count is needed (ties keep it), so two hash aggregates suffice: the tallies, then their maxima -- no window, no sort
    k = [case_key, *keys]
    v = _tallies(responses, k, label).groupBy(*k).agg(F.max("_top").alias("n_vote"), F.sum("_n").alias("n_answers"))
    v = v.select(*keys, case_key, "n_vote", "n_answers")
    den = F.lit(float(expected_runs)) if denominator == "expected" else F.col("n_answers").cast("double")
    return v.withColumn("consistency", F.col("n_vote") / den)


def mean_consistency(per_case: DataFrame, keys: Sequence[str]) -> DataFrame:
    return per_case.groupBy(*keys).agg(F.avg("consistency").alias("mean_consistency"), F.count("*").alias("n_cases"))


def correct_per_case(graded: DataFrame, keys: Sequence[str], case_key: str = "case_id") -> DataFrame:
    return graded.groupBy(*keys, case_key).agg(F.count_if("correct").alias("n_correct"), F.count("*").alias("n_runs"))


def accuracy_by_run(graded: DataFrame, keys: Sequence[str], run: str = "run") -> DataFrame:
    return (graded.groupBy(*keys, run)
            .agg(F.count_if("correct").alias("n_correct"), F.count("*").alias("n"))
            .withColumn("acc", F.col("n_correct") / F.col("n")))


def vote_frequency(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each label is the plurality vote; ties reported as label 'TIE'."""
    return (votes.withColumn("vote_label", F.coalesce(F.col("vote"), F.lit("TIE")))
            .groupBy(*keys, "vote_label").agg(F.count("*").alias("n")))


def zero_filled_counts(values: DataFrame, keys: Sequence[str], value: str, lo: int, hi: int) -> DataFrame:
    """Count of each ``value`` per group, zero-filled over the whole numbers lo..hi; other values keep rows of their own.

    The (group, value) grid is generated from the distinct groups (few) by ``explode(sequence)``
    and joined to the counts on the full key; no cross join."""
    kind = values.schema[value].dataType
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    grid = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(lo), F.lit(hi)).cast(T.ArrayType(kind))).alias(value))
    return grid.join(counts, [*keys, value], "full").select(*keys, value, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def correct_count_histogram(per_case: DataFrame, keys: Sequence[str], runs: int = 10) -> DataFrame:
    return zero_filled_counts(per_case.withColumn("n_correct", F.col("n_correct").cast("int")), keys, "n_correct", 0, runs)


def never_correct(per_case: DataFrame, keys: Sequence[str]) -> DataFrame:
    return per_case.groupBy(*keys).agg(F.count_if(F.col("n_correct") == 0).alias("n_never_correct"))


def case_summary(graded: DataFrame, keys: Sequence[str], case_key: str = "case_id", label: str = "response") -> DataFrame:
    """Correct count and plurality of each (keys, case) from one scan: n_correct, n_runs, top_n, tie, n_vote (NULL on a tie)."""
    out = _top_counts(graded, [case_key, *keys], label, F.count_if("correct").alias("n_correct"), F.count("*").alias("n_runs"), also=["n_correct", "n_runs"])
    return out.select(*keys, case_key, "n_correct", "n_runs", "top_n", "tie", F.when(~F.col("tie"), F.col("top_n")).alias("n_vote"))


def always_correct_or_wrong(cases: DataFrame, keys: Sequence[str], runs: int = 10) -> DataFrame:
    """Of ``case_summary`` rows: cases correct in every run, and consistent (same label every run) but wrong."""
    return cases.groupBy(*keys).agg(
        F.count_if(F.col("n_correct") == runs).alias("n_correct_all"),
        (F.count_if(F.col("n_vote") == runs) - F.count_if(F.col("n_correct") == runs)).alias("n_consistently_wrong"),
    )


def dominance(per_case: DataFrame, group: Sequence[str], competitor: str = "model", case_key: str = "case_id") -> DataFrame:
    """Per (group, competitor): cases where its correct count is >= the best over competitors (a window of the competitors of one case)."""
    best = F.max("n_correct").over(Window.partitionBy(*group, case_key))
    return per_case.withColumn("_best", best).groupBy(*group, competitor).agg(F.count_if(F.col("n_correct") >= F.col("_best")).alias("best_or_tied_cases"))


def by_level(per_case: DataFrame, keys: Sequence[str], level_col: str, levels: Sequence, value: str = "n_correct",
             case_key: str = "case_id", prefix: str = "v") -> DataFrame:
    """Conditional pivot of ``value`` by known levels: one row per (keys, case)."""
    aggs = [F.max(F.when(F.col(level_col) == F.lit(lv), F.col(value))).alias(f"{prefix}{i}") for i, lv in enumerate(levels)]
    return per_case.groupBy(*keys, case_key).agg(*aggs)


def temperature_comparison(per_case: DataFrame, temps: Sequence[float], pairs: Sequence[tuple[int, int]],
                           keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per model: number of cases where temperature a has more correct runs than temperature b."""
    wide = by_level(per_case, keys, "temperature", temps)
    rows = []
    for a, b in pairs:
        rows.append(F.struct(F.lit(float(temps[a])).alias("t_a"), F.lit(float(temps[b])).alias("t_b"),
                             (F.col(f"v{a}") > F.col(f"v{b}")).alias("gt")))
    x = wide.select(*keys, F.explode(F.array(*rows)).alias("p"))
    return x.groupBy(*keys, "p.t_a", "p.t_b").agg(F.count_if("p.gt").alias("n_cases_a_gt_b"))


def superiority_vs_set(per_case: DataFrame, group: Sequence[str], chosen: str, others: Sequence[str],
                       competitor: str = "model", case_key: str = "case_id") -> DataFrame:
    """Cases where the chosen competitor's correct count is >= each of ``others``."""
    sel = per_case.filter(F.col(competitor).isin(chosen, *others))
    agg = sel.groupBy(*group, case_key).agg(
        F.max(F.when(F.col(competitor) == chosen, F.col("n_correct"))).alias("mine"),
        F.max(F.when(F.col(competitor) != chosen, F.col("n_correct"))).alias("theirs"),
    )
    return (agg.groupBy(*group)
            .agg(F.count_if(F.col("mine") >= F.col("theirs")).alias("n_cases"))
            .withColumn(competitor, F.lit(chosen)))


def first_best_level(per_case: DataFrame, keys: Sequence[str], level_col: str, levels: Sequence) -> DataFrame:
    """Cases where the first level is the (first) argmax of the correct count across levels."""
    wide = by_level(per_case, keys, level_col, levels)
    rest = [F.col(f"v{i}") for i in range(1, len(levels))]
    return wide.groupBy(*keys).agg(F.count_if(F.col("v0") >= F.greatest(*rest)).alias("n_first_best"))


def consistency_correctness_heatmap(cases: DataFrame, keys: Sequence[str], runs: int = 10) -> DataFrame:
    """Zero-filled cells (bucket of majority count x correct count) of ``case_summary`` rows; ties excluded.

    Buckets: runs, runs-1, runs-2, and '<=runs-3' (small counts land in the last bucket).  The cells of a group are one row of
    conditional counts, unfolded."""
    bucket = F.when(F.col("n_vote") >= runs - 2, F.col("n_vote")).otherwise(F.lit(runs - 3))
    cells = [(b, c) for b in range(runs - 3, runs + 1) for c in range(runs + 1)]
    # the few cells that occur are counted first, so that a case is looked at once and not for every cell
    seen = cases.groupBy(*keys, bucket.alias("_b"), F.col("n_correct").alias("_c")).agg(F.count("n_vote").alias("_n"))
    counted = seen.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when((F.col("_b") == b) & (F.col("_c") == c), F.col("_n"))), F.lit(0)).alias(f"_{b}_{c}") for b, c in cells])
    label = lambda b: f"<={b / runs:.1f}" if b == runs - 3 else f"{b / runs:.1f}"
    rows = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(label(b)).alias("bucket_label"), F.lit(c).alias("n_correct"), F.col(f"_{b}_{c}").alias("n")) for b, c in cells])
    return counted.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, missing, mean, sd (sample), median, q1, q3, min, max.  Percentiles are exact with linear
    interpolation (pandas default); Spark's exact percentile keeps a value->count map, so its
    memory is bounded by distinct values (Likert: 5), not rows."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.count_if(v.isNull()).alias("missing"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.percentile(v, 0.5).alias("median"),
        F.percentile(v, 0.25).alias("q1"),
        F.percentile(v, 0.75).alias("q3"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
    )


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def likert_percent(df: DataFrame, keys: Sequence[str], value: str = "score", levels=(1, 2, 3, 4, 5)) -> DataFrame:
    """Percent of each score within (keys), zero-filled over ``levels``; averaged scores between levels count as they are."""
    base = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    counts = zero_filled_counts(base, keys, value, min(levels), max(levels))
    w_total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return (counts.join(w_total, list(keys))
            .withColumn("percent", F.col("n") * 100.0 / F.col("total")).drop("total"))


def median_iqr(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    out = df.groupBy(*keys).agg(F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q1"),
                                F.percentile(v, 0.75).alias("q3"), F.count(v).alias("n"))
    return out.withColumn("iqr", F.col("q3") - F.col("q1"))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Box-plot numbers: quartiles and whiskers (last data point within 1.5 IQR of the box), from one value histogram of each group
    (memory: the distinct values of a group, as for the exact percentile)."""
    keys = list(keys)
    h = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    q = h.groupBy(*keys).agg(*[F.percentile("_v", p, F.col("_n")).alias(c) for c, p in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))],
                             F.sum("_n").alias("n"), F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_n").alias("n"))).alias("_vs"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({"_lo": F.col("q1") - 1.5 * F.col("iqr"), "_hi": F.col("q3") + 1.5 * F.col("iqr")})
    values = lambda keep: F.transform(F.filter("_vs", keep), lambda x: x["v"])
    outside = F.filter("_vs", lambda x: (x["v"] < F.col("_lo")) | (x["v"] > F.col("_hi")))
    return q.select(*keys, "median", "q1", "q3", "n", "iqr", F.array_min(values(lambda x: x["v"] >= F.col("_lo"))).alias("whisker_low"),
                    F.array_max(values(lambda x: x["v"] <= F.col("_hi"))).alias("whisker_high"),
                    F.aggregate(outside, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_outliers"))


def case_order(per_case: DataFrame, keys: Sequence[str], by: str = "n_correct", unit: str = "case_id") -> DataFrame:
    """``position`` of each case in the order of (``by``, ``unit``) within ``keys``; ``unit`` is unique, of any type and distribution."""
    return order_rank(per_case.select(*keys, unit, by), keys, [by, unit], "position")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], cuts: int = CUTS) -> DataFrame:
    """(keys..., p0, p1, ...): percentiles of a continuous ``value``, exact with linear interpolation, equal to ``percentile``.

    ``percentile`` holds a map of all distinct values of a group in one task.  Here equal values are counted first; the counts of
    the buckets between ``cuts`` sampled points say in which bucket each order statistic lies, and only rows of
    those buckets are sorted and counted through.  No task holds more than about 1/``cuts`` of the distinct values.
    Rows without a value don't count; a group without one has no row."""
    keys = list(keys)
    h = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    b = with_bucket(h, ["_v"], cuts)
    per = b.groupBy(*keys, "_bk").agg(F.sum("_n").alias("_c"))
    group = Window.partitionBy(*keys)
    per = per.withColumns({"_before": F.coalesce(F.sum("_c").over(group.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                           "_all": F.sum("_c").over(group)})
    wanted = []
    for i, q in enumerate(qs):
        pos = (F.col("_all") - 1) * F.lit(float(q))
        wanted += [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), at(pos).cast("bigint").alias("p"), pos.alias("pos")) for side, at in ((0, F.floor), (1, F.ceil))]
    inside = F.filter(F.array(*wanted), lambda t: (t["p"] >= F.col("_before")) & (t["p"] < F.col("_before") + F.col("_c")))
    per = per.withColumn("_ts", inside).where(F.size("_ts") > 0)
    per = per.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_bk").alias("_kb"), "_before", "_ts")
    same = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)] + [F.col("_bk") == F.col("_kb")]
    rows = b.join(per, same)
    run = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_bk").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_at", F.col("_before") + run)
    hit = F.filter("_ts", lambda t: (t["p"] >= F.col("_at")) & (t["p"] < F.col("_at") + F.col("_n")))
    hits = rows.select(*keys, "_v", F.explode(hit).alias("_t"))

    def pick(i: int, side: int, what: str = "_v") -> Column:
        return F.max(F.when((F.col("_t.i") == i) & (F.col("_t.side") == side), F.col(what)))

    out = []
    for i in range(len(qs)):
        lo, hi, pos = pick(i, 0), pick(i, 1), pick(i, 0, "_t.pos")
        out.append(F.when(F.ceil(pos) == F.floor(pos), lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi).alias(f"p{i}"))
    return hits.groupBy(*keys).agg(*out)


def describe_continuous(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``describe`` of a value with any number of distinct values: its percentiles come from ``exact_percentiles``."""
    keys = list(keys)
    v = F.col(value).cast("double")
    plain = df.groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                                  F.min(v).alias("minimum"), F.max(v).alias("maximum"))
    ps = exact_percentiles(df, keys, value, (0.5, 0.25, 0.75)).select(
        *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("p0").alias("median"), F.col("p1").alias("q1"), F.col("p2").alias("q3"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)]
    return plain.join(ps, same, "left").select(*keys, "n", "missing", "mean", "sd", "median", "q1", "q3", "minimum", "maximum")
