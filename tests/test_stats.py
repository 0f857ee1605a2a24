"""Numeric goldens for the statistics (textbook values; scipy is not installed)."""

import math

import pytest

from pyspark.sql import functions as F

from caremart.functions.pvalues import normal_pvalue, t_pvalue
from caremart.operators import stats as ST


def p_values(spark, rows, normal=False):
    df = spark.createDataFrame(rows, "t double, dof double")
    p = normal_pvalue(F.col("t")) if normal else t_pvalue(F.col("t"), F.col("dof"))
    return [r["p"] for r in df.select(p.alias("p")).collect()]


def test_t_pvalue_goldens(spark):
    nan, inf = float("nan"), float("inf")
    got = p_values(spark, [(2.0, 10.0), (0.0, 5.0), (2.228138852, 10.0), (1.959963985, 1e7), (-5.0, 1.0), (50.0, 2.0),
                           (None, 3.0), (nan, 3.0), (1.0, 0.0), (inf, 3.0)])
    want = [0.0733880347, 1.0, 0.05, 0.05, 1 - 2 / math.pi * math.atan(5), 1 - 50 / math.sqrt(2502), None, None, None,
            0.0]
    for g, w in zip(got, want):
        assert g == w if w is None else g == pytest.approx(w, abs=1e-6)


def test_normal_goldens(spark):
    zs = [0.0, 0.5, -1.959963985, 6.0, 30.0]
    for z, p in zip(zs, p_values(spark, [(z, None) for z in zs], normal=True)):
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)


def test_equal_samples_and_constant_groups(spark):
    same = spark.createDataFrame([(g, float(v)) for g in "ab" for v in range(8)], "g string, v double")
    r = ST.mannwhitney_pairs(same, "g", "v").collect()[0]
    assert (r["z"], r["p_value"]) == (0.0, 1.0)
    assert ST.pairwise_significance(same, "g", "v").collect()[0]["p_value"] == pytest.approx(1.0)
    flat = spark.createDataFrame([(g, 3.0) for g in "ab" for _ in range(8)], "g string, v double")
    r = ST.label_significance(ST.pairwise_significance(flat, "g", "v")).collect()[0]
    assert r["p_value"] is None and r["p_value_formatted"] is None and r["effect_size_interpretation"] is None
    assert r["significant"] is False


def test_ttest_and_cohens_d(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    b = [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    r = ST.pairwise_significance(df, "g", "v").collect()[0]
    # pooled variance = (3.5*5 + 14*5)/10 = 8.75; t = -3.5 / sqrt(8.75/3)
    assert r["t_stat"] == pytest.approx(-3.5 / math.sqrt(8.75 / 3))
    assert r["effect_size"] == pytest.approx(-3.5 / math.sqrt(8.75))
    assert r["p_value"] == pytest.approx(0.06757, abs=1e-4)
    assert r["significant"] is False


def test_min_group_size(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5 + [("b", 2.0)] * 9, "g string, v double")
    assert ST.pairwise_significance(df, "g", "v").count() == 0


def test_mannwhitney_u(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0]
    y = [3.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    df = spark.createDataFrame([("x", v) for v in x] + [("y", v) for v in y], "g string, v double")
    r = ST.mannwhitney_pairs(df, "g", "v").collect()[0]
    # pairs (xi > yj) + 0.5 ties: only x=3 ties y=3
    assert r["u_stat"] == pytest.approx(2.5)  # x=3: 0.5 (tie), x=4: 1, x=5: 1
    assert 0 < r["p_value"] < 0.05


def test_correlation_and_ols(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, None if i == 3 else float(-i)) for i in range(10)],
                               "x double, y double, z double")
    c = {(r["var1"], r["var2"]): r["correlation"] for r in ST.correlation_matrix(df, ["x", "y", "z"]).collect()}
    assert c[("x", "y")] == pytest.approx(1.0)
    assert c[("x", "z")] == pytest.approx(-1.0)
    o = ST.ols_by(df, None, "y", "x").collect()[0]
    assert o["slope"] == pytest.approx(2.0) and o["intercept"] == pytest.approx(1.0)


def test_labels(spark):
    df = spark.createDataFrame([(0.0005, 0.9, True), (0.2, 0.3, False)], "p_value double, effect_size double, "
                               "significant boolean")
    rows = ST.label_significance(df).collect()
    assert rows[0]["p_value_formatted"] == "< 0.001" and rows[0]["effect_size_interpretation"] == "Large"
    assert rows[1]["p_value_formatted"] == "0.2000" and rows[1]["effect_size_interpretation"] == "Small"


def test_mannwhitney_exact_for_small_samples_without_ties(spark):
    """Against all ways to deal the ranks; with ties, or two large groups, the normal approximation stays."""
    import itertools
    import random
    rnd = random.Random(4)
    groups = {"a": rnd.sample(range(100), 5), "b": rnd.sample(range(100, 300), 8), "c": [x + 0.5 for x in rnd.sample(range(300), 4)],
              "d": [-7.0], "e": [1000.5 + i for i in range(40)], "f": [2000.5 + i * 0.1 for i in range(30)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    got = {(r["group_1"], r["group_2"]): r for r in ST.mannwhitney_pairs(
        spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for (g, h), r in got.items():
        a, b = groups[g], groups[h]
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        assert r["u_stat"] == u
        if len(a) + len(b) > 14:
            continue
        low, n = min(u, len(a) * len(b) - u), len(a) + len(b)
        us = [sum(d) - len(a) * (len(a) + 1) / 2 for d in itertools.combinations(range(1, n + 1), len(a))]
        assert r["p_value"] == pytest.approx(min(1.0, 2 * sum(x <= low for x in us) / len(us)), rel=1e-12)
    assert got["a", "e"]["p_value"] == pytest.approx(2 / __import__("math").comb(45, 5), rel=1e-12)  # one small group is enough
    from caremart.functions.pvalues import normal_pvalue
    z = spark.createDataFrame([(got["e", "f"]["z"],)], "z double").select(normal_pvalue(F.col("z")).alias("p")).first()["p"]
    assert got["e", "f"]["p_value"] == z
    tied = ST.mannwhitney_pairs(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)], "g string, v double"),
                                "g", "v").first()
    z = spark.createDataFrame([(tied["z"],)], "z double").select(normal_pvalue(F.col("z")).alias("p")).first()["p"]
    assert tied["p_value"] == z
