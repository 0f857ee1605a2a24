"""STA1-STA10: pairwise tests, effect sizes, correlations and linear trends.

Data-sized work stays in Catalyst: each group is reduced to sufficient
statistics (n, mean, variance) or to (value, count) pairs before any pairing,
so pairs are formed between k aggregated groups, never between rows.  P-values
are column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.functions.prefix import prefix_sums
from caremart.functions.pvalues import normal_pvalue, t_pvalue


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per-group n, mean and sample variance of the non-null values."""
    return (df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group)
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")))


def _pairs(m: DataFrame, group: str, min_n: int) -> DataFrame:
    """Unordered pairs (a < b) of aggregated groups with n >= ``min_n`` (k rows, k(k-1)/2 pairs).

    The pairs are the feature.  Catalyst chooses the side to broadcast by its size.
    """
    m = m.where(F.col("n") >= min_n)
    a = m.select(*[F.col(c).alias(f"{c}_1") for c in m.columns])
    b = m.select(*[F.col(c).alias(f"{c}_2") for c in m.columns])
    return a.join(b, F.col(f"{group}_1") < F.col(f"{group}_2"))  # k aggregated rows per side


def effect_sizes(df: DataFrame, group: str = "intervention_name", value: str = "normalized_score",
                 min_n: int = 6) -> DataFrame:
    """STA1/STA4: pooled-variance t statistic, degrees of freedom and Cohen's d per pair of groups."""
    p = _pairs(group_moments(df, group, value), group, min_n)
    dof = F.col("n_1") + F.col("n_2") - 2
    sp2 = ((F.col("n_1") - 1) * F.col("var_1") + (F.col("n_2") - 1) * F.col("var_2")) / dof
    diff = F.col("mean_1") - F.col("mean_2")
    t = F.try_divide(diff, F.sqrt(sp2 * (1.0 / F.col("n_1") + 1.0 / F.col("n_2"))))
    d = F.try_divide(diff, F.sqrt(sp2))
    return p.select(F.col(f"{group}_1").alias("group_1"), F.col(f"{group}_2").alias("group_2"),
                    F.col("n_1"), F.col("n_2"), t.alias("t_stat"), dof.cast("double").alias("dof"),
                    d.alias("effect_size"))


def ttest_pairs(df: DataFrame, group: str = "intervention_name", value: str = "normalized_score",
                min_n: int = 6) -> DataFrame:
    """STA1: Student two-sample t-test (pooled variance) for every pair of groups, with p-values."""
    e = effect_sizes(df, group, value, min_n)
    return e.withColumn("p_value", t_pvalue(F.col("t_stat"), F.col("dof")))


def pairwise_significance(df: DataFrame, group: str = "intervention_name", value: str = "normalized_score",
                          min_n: int = 6, alpha: float = 0.05) -> DataFrame:
    """STA3: all-pairs t-test and Cohen's d for groups with more than five values; significant = p < alpha."""
    t = ttest_pairs(df, group, value, min_n)
    return t.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def exact_u_tails(sizes: DataFrame) -> DataFrame:
    """The exact two-sided tail of Mann-Whitney's U: ``n_1, n_2, u, p_exact`` for every ``u`` up to the mean.

    ``sizes`` has one row for each pair of group sizes.  The number of ways to reach
    each U is a coefficient of the Gaussian binomial: the product over i up to the
    smaller size of (1 - q^(larger + i)) / (1 - q^i), built up one factor at a time.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n_1, n_2 in zip(frame["n_1"], frame["n_2"]):
                small, large = sorted((int(n_1), int(n_2)))
                ways = np.zeros(small * large + 1)
                ways[0] = 1
                for i in range(1, small + 1):
                    if large + i < len(ways):
                        ways[large + i:] -= ways[:-(large + i)].copy()
                    for r in range(min(i, len(ways))):
                        ways[r::i] = np.cumsum(ways[r::i])
                upto = np.cumsum(ways[:small * large // 2 + 1]) / math.comb(small + large, small)
                yield pd.DataFrame({"n_1": n_1, "n_2": n_2, "u": np.arange(len(upto)), "p_exact": np.minimum(1.0, 2 * upto)})

    return sizes.mapInPandas(run, "n_1 long, n_2 long, u long, p_exact double")


def mannwhitney_pairs(df: DataFrame, group: str = "intervention_name", value: str = "normalized_score",
                      min_n: int = 1, exact_n: int = 8) -> DataFrame:
    """STA2: two-sided Mann-Whitney U per pair of groups, with its p-value.

    A pair without ties in which one group has at most ``exact_n`` values takes the
    exact null distribution (``exact_u_tails``, joined on the sizes and U), all others the
    normal approximation with tie and continuity corrections, as the reference's test
    does; ``z`` is that of the approximation.  Each group is first reduced to (value, count); a pair only sees the distinct
    values of its two groups, ranked inside the pair's window.
    """
    src = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    counts = src.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy(group).agg(F.sum("c").alias("n"))
    pairs = _pairs(sizes, group, min_n).select(F.col(f"{group}_1").alias("g1"), F.col(f"{group}_2").alias("g2"),
                                               F.col("n_1"), F.col("n_2"))
    va = pairs.join(counts, F.col("g1") == F.col(group)).select(
        "g1", "g2", "n_1", "n_2", F.col(value).alias("v"), F.col("c").alias("ca"), F.lit(0).cast("long").alias("cb"))
    vb = pairs.join(counts, F.col("g2") == F.col(group)).select(
        "g1", "g2", "n_1", "n_2", F.col(value).alias("v"), F.lit(0).cast("long").alias("ca"), F.col("c").alias("cb"))
    per = va.unionByName(vb).groupBy("g1", "g2", "n_1", "n_2", "v").agg(F.sum("ca").alias("ca"),
                                                                        F.sum("cb").alias("cb"))
    # values of group 2 below each value: a skew-safe running sum (exclusive) per pair
    per = prefix_sums(per, ["g1", "g2"], ["v"], ["cb"]).withColumn("cb_lt", F.col("cb_cum") - F.col("cb"))
    g = per.groupBy("g1", "g2", "n_1", "n_2").agg(
        F.sum(F.col("ca") * (F.col("cb_lt") + 0.5 * F.col("cb"))).alias("u1"),
        F.sum(F.pow(F.col("ca") + F.col("cb"), 3) - (F.col("ca") + F.col("cb"))).alias("ties"))
    n1, n2 = F.col("n_1").cast("double"), F.col("n_2").cast("double")
    n = n1 + n2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    u = F.greatest(F.col("u1"), n1 * n2 - F.col("u1"))
    # the continuity correction stops at the mean: two like samples have z = 0 and p = 1
    z = F.try_divide(F.greatest(u - mu - 0.5, F.lit(0.0)), sigma)
    g = g.withColumns({"_z": z, "_u": F.least(F.col("u1"), n1 * n2 - F.col("u1")).cast("long"),
                       "_exact": (F.col("ties") == 0) & (F.least("n_1", "n_2") <= exact_n)})
    tails = exact_u_tails(g.where("_exact").select("n_1", "n_2").distinct())
    g = g.join(tails.select(F.col("n_1").alias("_n_1"), F.col("n_2").alias("_n_2"), F.col("u").alias("_at"), "p_exact"),
               F.col("_exact") & (F.col("n_1") == F.col("_n_1")) & (F.col("n_2") == F.col("_n_2")) & (F.col("_u") == F.col("_at")),
               "left")
    return g.select(F.col("g1").alias("group_1"), F.col("g2").alias("group_2"), "n_1", "n_2",
                    F.col("u1").alias("u_stat"), F.col("_z").alias("z"),
                    F.when(F.col("_exact"), F.col("p_exact")).otherwise(normal_pvalue(F.col("_z"))).alias("p_value"))


# Effect-size magnitude cut points and labels.
EFFECT_LABELS = [(0.8, "Large"), (0.5, "Medium"), (0.2, "Small")]


def label_significance(df: DataFrame, p: str = "p_value", d: str = "effect_size",
                       sig: str = "significant") -> DataFrame:
    """STA5: p-value text (4 decimals or '< 0.001'), effect magnitude label and a yes/no symbol.

    A test without a p-value or effect (constant groups) has no text and no label.
    """
    ad = F.abs(F.col(d))
    mag = F.when(ad.isNull() | F.isnan(ad), F.lit(None).cast("string"))
    for cut, name in EFFECT_LABELS:
        mag = mag.when(ad > cut, name)
    mag = mag.otherwise("Negligible")
    txt = (F.when(F.col(p).isNull() | F.isnan(F.col(p)), F.lit(None).cast("string"))
           .when(F.col(p) >= 0.001, F.format_number(F.col(p), 4)).otherwise(F.lit("< 0.001")))
    return df.withColumns({"p_value_formatted": txt, "effect_size_interpretation": mag,
                           "significant_symbol": F.when(F.col(sig), "✓").otherwise("✗")})


def significance_counts(sig: DataFrame, col: str = "significant") -> DataFrame:
    """STA6: number of significant pairs out of all compared pairs."""
    return sig.agg(F.count_if(F.col(col)).alias("significant_pairs"), F.count(F.lit(1)).alias("total_pairs"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """STA7: Pearson correlation of every ordered pair of columns, long format (pairwise NULL deletion).

    One pass computes the upper triangle and diagonal; the lower triangle mirrors it.
    """
    cols = list(cols)
    aggs = [F.corr(a, b).alias(f"c_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    one = df.agg(*aggs)
    entries = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                        F.col(f"c_{min(i, j)}_{max(i, j)}").alias("correlation"))
               for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def strong_correlations(corr: DataFrame, cols: Sequence[str], threshold: float = 0.5,
                        strong: float = 0.7) -> DataFrame:
    """STA8: upper-triangle pairs with |r| > threshold, labelled strong/moderate and positive/negative."""
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    up = corr.where(order[F.col("var1")] < order[F.col("var2")])
    return (up.where(F.abs("correlation") > threshold)
            .withColumns({"strength": F.when(F.abs("correlation") > strong, "strong").otherwise("moderate"),
                          "direction": F.when(F.col("correlation") > 0, "positive").otherwise("negative")}))


def ols_by(df: DataFrame, by: str | None, y: str, x: str, min_n: int = 6) -> DataFrame:
    """STA9: least-squares slope, intercept and R^2 of y on x per group (groups with >= ``min_n`` points).

    A date ``x`` is taken as days since 1970-01-01.
    """
    xcol = F.col(x)
    if dict(df.dtypes).get(x) == "date":
        xcol = F.datediff(F.col(x), F.lit("1970-01-01").cast("date")).cast("double")
    src = df.select(*([by] if by else []), F.col(y).cast("double").alias("_y"), xcol.cast("double").alias("_x"))
    src = src.where(F.col("_y").isNotNull() & F.col("_x").isNotNull())
    g = src.groupBy(by) if by else src.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"),
                F.regr_intercept("_y", "_x").alias("intercept"), F.regr_r2("_y", "_x").alias("r2"))
    return out.where(F.col("n") >= min_n)
