"""Hand-computed cases for the closed-form statistics (published formulas / worked examples)."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradebook.functions.text import format_ci
from gradebook.functions.stats import chi2_sf_sql, erfc_sql, wilson_sql
from gradebook.operators import agreement as A
from gradebook.operators import inference as I


def _duck(expr):
    return duckdb.connect().execute(f"SELECT {expr}").fetchall()[0][0]


@pytest.mark.parametrize("x", [0.0, 0.3, 1.0, 2.2, 2.99, 3.0, 4.5, 7.0])
def test_erfc_matches_math(x):
    assert _duck(erfc_sql(repr(x))) == pytest.approx(math.erfc(x), rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("crit,df", [(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251178, 3),
                                     (9.487729036781154, 4), (11.070497693516351, 5), (26.29622760486423, 16)])
def test_chi2_sf_at_critical_values(crit, df):
    assert _duck(chi2_sf_sql(repr(crit), str(df))) == pytest.approx(0.05, abs=1e-12)


def test_wilson_known_example():
    # 81 successes of 263 (Wilson 1927 style check): centre/half-width formula
    lo, hi = (_duck(e) for e in wilson_sql("81.0", "263.0"))
    p, n, z = 81 / 263, 263, 1.959963984540054
    c = (p + z * z / (2 * n)) / (1 + z * z / n)
    h = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    assert (lo, hi) == pytest.approx((c - h, c + h), abs=1e-15)
    assert lo < p < hi


def test_mcnemar_exact(spark):
    rows = [(True, False)] * 5 + [(False, True)] * 1 + [(True, True)] * 10
    df = spark.createDataFrame(rows, "x boolean, y boolean").withColumn("g", F.lit(1))
    r = I.mcnemar_exact(df, ["g"]).first()
    assert (r.n_10, r.n_01) == (5, 1)
    assert r.p_value == pytest.approx(2 * (1 + 6) / 64)
    none = spark.createDataFrame([(True, True)], "x boolean, y boolean").withColumn("g", F.lit(1))
    assert I.mcnemar_exact(none, ["g"]).first().p_value == pytest.approx(1.0)


def test_cohen_kappa_known(spark):
    # 2x2 example: n = 50, po = 0.7, pe = 0.5 -> kappa 0.4
    cells = spark.createDataFrame([(1, "a", "a", 20), (1, "a", "b", 5), (1, "b", "a", 10), (1, "b", "b", 15)], "g int, x string, y string, n long")
    k = A.cohen_kappa(cells, ["g"]).first().kappa
    assert k == pytest.approx(0.4)


def test_weighted_kappa_matches_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(1, 6, 200)
    b = np.clip(a + rng.integers(-1, 2, 200), 1, 5)
    labs = sorted(set(a) | set(b))
    L = len(labs)
    O = np.zeros((L, L))
    for u, v in zip(a, b):
        O[labs.index(u), labs.index(v)] += 1
    E = np.outer(O.sum(1), O.sum(0)) / O.sum()
    idx = np.arange(L)
    W = (idx[:, None] - idx[None, :]) ** 2
    expect = 1 - (W * O).sum() / (W * E).sum()
    df = spark.createDataFrame([(1, float(u), float(v)) for u, v in zip(a, b)], "g int, x double, y double")
    got = A.cohen_kappa(A.contingency(df, ["g"]), ["g"], weights="quadratic").first().kappa
    assert got == pytest.approx(expect, rel=1e-12)


def test_icc_shrout_fleiss(spark):
    # Shrout & Fleiss (1979) data: 6 targets x 4 judges; ICC(2,1) = 0.29, ICC(2,4) = 0.62
    data = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]
    rows = [(1, t, f"j{j}", float(v)) for t, r in enumerate(data) for j, v in enumerate(r)]
    df = spark.createDataFrame(rows, "g int, case_id int, evaluator string, score double")
    r = A.icc2(df, ["g"]).first()
    assert round(r.icc2_1, 2) == 0.29 and round(r.icc2_k, 2) == 0.62


def test_wilcoxon_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 6, 300).astype(float)
    y = np.clip(x + rng.integers(-2, 3, 300), 1, 5).astype(float)
    d = y - x
    d = d[d != 0]
    ad = np.abs(d)
    order = np.argsort(ad, kind="mergesort")
    ranks = np.empty(len(ad))
    sorted_ad = ad[order]
    i = 0
    while i < len(ad):
        j = i
        while j + 1 < len(ad) and sorted_ad[j + 1] == sorted_ad[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    wp, wn = ranks[d > 0].sum(), ranks[d < 0].sum()
    n = len(d)
    _, t = np.unique(ad, return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (t ** 3 - t).sum() / 48
    z = (min(wp, wn) - n * (n + 1) / 4) / math.sqrt(var)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g int, x double, y double")
    r = I.wilcoxon_signed_rank(df, ["g"]).first()
    assert r.statistic == pytest.approx(min(wp, wn))
    assert r.z == pytest.approx(z, rel=1e-12)
    assert r.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)
    assert r.rank_biserial == pytest.approx((wp - wn) / (n * (n + 1) / 2))


def test_wilcoxon_all_zero(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0)] * 5, "g int, x double, y double")
    r = I.wilcoxon_signed_rank(df, ["g"]).first()
    assert (r.statistic, r.p_value) == (0.0, 1.0)


def _signed(spark, ds):
    return spark.createDataFrame([(1, 0.0, float(d)) for d in ds], "g int, x double, y double")


@pytest.mark.parametrize("n,t,p", [(5, 0, 2 / 32), (5, 1, 4 / 32), (10, 8, 50 / 1024), (25, 89, 0.04826)])
def test_wilcoxon_exact_without_ties(spark, n, t, p):
    """Hand values: of 2^n signs, those whose rank sum is at most T (n = 25: 89 is the tabulated 5 % point)."""
    minus, left = set(), t
    for r in range(n, 0, -1):
        if r <= left:
            minus.add(r)
            left -= r
    ds = [-r if r in minus else r for r in range(1, n + 1)]
    count = [1] + [0] * t
    for r in range(1, n + 1):
        count = [c + (count[s - r] if s >= r else 0) for s, c in enumerate(count)]
    for method in ("auto", "exact"):
        r = I.wilcoxon_signed_rank(_signed(spark, ds), ["g"], method=method).first()
        assert (r.statistic, r.method) == (t, "exact")
        assert r.p_value == pytest.approx(min(1, 2 * sum(count) / 2 ** n), rel=1e-12) and r.p_value == pytest.approx(p, abs=5e-4)
    assert I.wilcoxon_signed_rank(_signed(spark, ds), ["g"], method="approx").first().method == "approx"


def test_wilcoxon_exact_with_ties_counts_signs(spark):
    ds = [1, 1, -1, 2, -2, 3, 3, 0, 4]
    ranks = {1: 2, 2: 4.5, 3: 6.5, 4: 8}
    rs = [ranks[abs(d)] for d in ds if d]
    t = min(sum(ranks[d] for d in ds if d > 0), sum(ranks[-d] for d in ds if d < 0))
    sums = [sum(r for i, r in enumerate(rs) if m >> i & 1) for m in range(2 ** len(rs))]
    r = I.wilcoxon_signed_rank(_signed(spark, ds), ["g"], method="exact").first()
    assert r.p_value == pytest.approx(min(1, 2 * sum(s <= t for s in sums) / len(sums)), rel=1e-12)
    assert I.wilcoxon_signed_rank(_signed(spark, ds), ["g"]).first().method == "approx"       # ties and a zero
    assert I.wilcoxon_signed_rank(_signed(spark, range(1, 52)), ["g"]).first().method == "approx"  # 51 pairs
    big = I.wilcoxon_signed_rank(_signed(spark, [(-1) ** k * k for k in range(1, 201)]), ["g"], method="exact").first()
    near = I.wilcoxon_signed_rank(_signed(spark, [(-1) ** k * k for k in range(1, 201)]), ["g"], method="approx").first()
    assert big.p_value == pytest.approx(near.p_value, abs=2e-3)


def test_display_rounds_the_number_itself(spark):
    values = [s * (2 * k + 1) / 2000 for k in range(2500) for s in (1, -1)] + [0.0375, 0.0625, 0.00049999999, -0.0001, 0.0, 1234.5678]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r[0]: r[1] for r in df.select("i", format_ci(F.col("v"), F.col("v"), F.lit(1.0))).collect()}
    assert got == {i: f"{v:.3f} [{v:.3f}, 1.000]" for i, v in enumerate(values)}


def test_bh_known(spark):
    ps = [0.01, 0.04, 0.03, 0.005, None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    out = {r.i: r for r in I.fdr_bh(df, "p").collect()}
    # sorted: .005, .01, .03, .04 -> adj .02, .02, .04, .04
    assert out[3].p_adj == pytest.approx(0.02) and out[0].p_adj == pytest.approx(0.02)
    assert out[2].p_adj == pytest.approx(0.04) and out[1].p_adj == pytest.approx(0.04)
    assert out[4].p_adj is None and all(out[k].reject for k in range(4))


def test_stuart_maxwell_k3_closed_form(spark):
    m = np.array([[20, 5, 3], [2, 15, 6], [4, 1, 10]], dtype=float)
    rows = [(1, str(i), str(j), int(m[i, j])) for i in range(3) for j in range(3)]
    cells = spark.createDataFrame(rows, "g int, x string, y string, n long")
    r = I.stuart_maxwell(cells, ["g"]).first()
    # closed form for k = 3 (Fleiss): X2 = (n23 d1^2 + n13 d2^2 + n12 d3^2) / (2 (n12 n23 + n12 n13 + n13 n23))
    d = m.sum(1) - m.sum(0)
    nb = lambda i, j: (m[i, j] + m[j, i]) / 2
    n12, n13, n23 = nb(0, 1), nb(0, 2), nb(1, 2)
    x2 = (n23 * d[0] ** 2 + n13 * d[1] ** 2 + n12 * d[2] ** 2) / (2 * (n12 * n23 + n12 * n13 + n13 * n23))
    assert r.statistic == pytest.approx(x2, rel=1e-10)
    assert r.df == 2


def test_chi2_association_shift(spark):
    cells = spark.createDataFrame([(1, "a", "a", 10), (1, "b", "b", 12), (1, "a", "b", 3)], "g int, x string, y string, n long")
    r = I.chi2_association(cells, ["g"]).first()
    o = np.array([[10, 3], [0, 12]], dtype=float) + 0.5
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    assert r.statistic == pytest.approx(((o - e) ** 2 / e).sum())
    assert r.df == 1


def test_student_t_quantile():
    assert I.student_t_quantile(0.975, 9) == pytest.approx(2.2621571627409915, rel=1e-9)
    assert I.student_t_quantile(0.975, 1) == pytest.approx(12.706204736174707, rel=1e-9)


def test_mcnemar_is_one_exact_rule_at_every_size(spark):
    """Against the incomplete beta's symmetric sum in whole numbers (small) and the normal limit (over 10^6 pairs)."""
    from fractions import Fraction

    def p(b, c):
        return spark.sql(f"SELECT {I.mcnemar_p_spark_sql('b', 'c')} AS p FROM (SELECT {b}L AS b, {c}L AS c)").first().p

    for b, c in [(0, 0), (0, 1), (3, 3), (1, 12), (20, 31), (400, 455), (0, 60)]:
        n = b + c
        want = min(Fraction(1), 2 * sum(Fraction(math.comb(n, i), 2 ** n) for i in range(min(b, c) + 1)))
        assert p(b, c) == pytest.approx(float(want), rel=1e-11)
    n, k = 4_000_000, 1_997_000
    z = (n / 2 - k - 0.5) / math.sqrt(n / 4)
    assert p(k, n - k) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


@pytest.mark.parametrize("x,df", [(3.2, 1), (10.0, 7), (120.0, 150), (250.0, 201), (9.0, 2)])
def test_chi2_sf_two_independent_forms_without_df_cap(spark, x, df):
    a = spark.sql(f"SELECT {chi2_sf_sql(repr(x) + 'D', str(df), 'spark')} AS p").first().p
    assert a == pytest.approx(_duck(chi2_sf_sql(repr(x), str(df))), rel=1e-10)


def test_icc_does_not_depend_on_the_common_level(spark):
    rng = np.random.default_rng(3)
    rows = [(1, i, r, float(v)) for i in range(40) for r, v in zip("ab", rng.integers(1, 6, 2))]
    def icc(shift):
        df = spark.createDataFrame([(g, i, r, v + shift) for g, i, r, v in rows], "g int, case_id int, evaluator string, score double")
        return A.icc2(df, ["g"]).first().icc2_1
    assert icc(1e8) == pytest.approx(icc(0.0), abs=1e-7)
