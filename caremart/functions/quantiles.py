"""Exact quantiles per group by histogram refinement, and modes.

Spark's exact ``median`` merges a value -> count map of every distinct value in
one task, and a gathered bracket of ties is as large as the column.  Here every
wanted rank keeps an interval of values that holds it, at first the group's
minimum and maximum.  One pass counts the values of the open intervals in bins (a
hash aggregate with map-side combine, so ties and hot groups cost one row per bin
and task) and narrows each interval to the smallest and largest value of its rank's
bin; an interval of one value is done.  A bin is one of ``BINS`` equal parts of the
interval and one power of two: both grow with the value, so there are at most
``BINS`` plus about 4,300 bins, and after the first pass an interval lies between
two neighbouring powers of two, infinities apart.  Each further pass takes 14 of the
52 bits between them, so ``PASSES`` passes end every column, whatever its values;
one or two are usual.  No values are gathered, the only window runs over the bins of
an interval, and there is one path for all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caremart.plans.materialize import write_stage

BINS = 1 << 14
PASSES = 5


def _power(v: Column) -> Column:
    """The power of two below a value's size, with its sign: it never falls where values grow."""
    size = F.when(F.abs(v) == float("inf"), 3000).otherwise(F.floor(F.log2(F.abs(v))) + 1100)
    return F.when(v == 0, 0).otherwise(F.signum(v) * size).cast("int")


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """The equal part of an interval that a value lies in; an infinite interval is not parted."""
    # halves of large ends, so that the width does not overflow; whole small ends, so that it does not vanish
    size, whole = F.greatest(F.abs(lo), F.abs(hi)), (v - lo) / (hi - lo)
    share = F.when(size < 1e300, whole).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    part = F.least(F.floor(share * BINS), F.lit(BINS - 1))
    return F.when(size < float("inf"), part).otherwise(0).cast("int")


def _ranked(df: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """``keys, _p, _frac, _x, _y``: the two order statistics around every probability of every group."""
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                                 for i, p in enumerate(probs)]))
    ends = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = ends.withColumn("_w", wanted).withColumn("_pos", (F.col("_n") - 1) * F.col("_w.p"))
    ranks = ranks.select(*keys, F.col("_w.i").alias("_p"), (F.col("_pos") - F.floor("_pos")).alias("_frac"), "_lo", "_hi",
                         F.explode(F.array(F.struct(F.lit(0).alias("s"), F.floor("_pos").alias("r")),
                                           F.struct(F.lit(1).alias("s"), F.ceil("_pos").alias("r")))).alias("_t"))
    state = write_stage(ranks.select(*keys, "_p", "_frac", F.col("_t.s").alias("_side"), F.col("_t.r").alias("_rank"),
                                     F.lit(0).cast("long").alias("_below"), "_lo", "_hi"), "quantile-ranks")
    interval = [*keys, "_lo", "_hi"]
    while not (open_ := state.filter("_lo < _hi")).isEmpty():
        spans = open_.select(*interval).distinct()
        values = df.join(spans, keys) if keys else df.crossJoin(F.broadcast(spans))  # at most two per probability
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        bins = (values.filter(v.between(lo, hi)).groupBy(*interval, F.struct(_part(v, lo, hi), _power(v)).alias("_bin"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_bin_lo"), F.max("_v").alias("_bin_hi")))
        upto = F.sum("_c").over(Window.partitionBy(*interval).orderBy("_bin"))
        bins = bins.withColumn("_upto", upto)
        here = F.col("_rank") - F.col("_below")
        found = (open_.join(bins, interval).filter((here >= F.col("_upto") - F.col("_c")) & (here < F.col("_upto")))
                 .select(*keys, "_p", "_frac", "_side", "_rank", (F.col("_below") + F.col("_upto") - F.col("_c"))
                         .alias("_below"), F.col("_bin_lo").alias("_lo"), F.col("_bin_hi").alias("_hi")))
        state = write_stage(state.filter("_lo = _hi").unionByName(found), "quantile-ranks")
    return state.groupBy(*keys, "_p").agg(F.max("_frac").alias("_frac"), F.max(F.when(F.col("_side") == 0, F.col("_lo")))
                                          .alias("_x"), F.max(F.when(F.col("_side") == 1, F.col("_lo"))).alias("_y"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
                    names: Sequence[str]) -> DataFrame:
    """``keys`` and one column per probability: exact, linearly interpolated quantiles of every group.

    NULL and NaN values are ignored; a group without values has no row.  NULL
    keys form no group.
    """
    keys = list(keys)
    v = F.col(col).cast("double")
    src = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    for k in keys:
        src = src.filter(F.col(k).isNotNull())
    at = _ranked(src, keys, probs).withColumn("_q", F.when(F.col("_x") == F.col("_y"), F.col("_x")).otherwise(
        F.col("_x") * (1 - F.col("_frac")) + F.col("_y") * F.col("_frac")))
    return at.groupBy(*keys).agg(*[F.max(F.when(F.col("_p") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])


def exact_median_values(df: DataFrame, cols: Sequence[str]) -> list[float | None]:
    """Exact medians of several columns as driver-side numbers; None for a column without values.

    All columns are read in the same passes, as (column, value) rows.
    """
    cols = list(cols)
    if not cols:
        return []
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v"))
                                         for i, c in enumerate(cols)])).alias("e")).select("e.k", "e.v")
    found = {r["k"]: r["m"] for r in exact_quantiles(rows, ["k"], "v", [0.5], ["m"]).collect()}
    return [found.get(i) for i in range(len(cols))]


def exact_medians(df: DataFrame, cols: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One row with the exact (interpolated) median of each column."""
    values = exact_median_values(df, cols)
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n) for v, n in zip(values, names or cols)])


def approx_medians(df: DataFrame, cols: Sequence[str], names: Sequence[str] | None = None,
                   accuracy: int = 10_000) -> DataFrame:
    """One row with ``percentile_approx(c, 0.5)`` per column (bounded sketch, not interpolated)."""
    names = list(names or cols)
    return df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).cast("double").alias(n)
                    for c, n in zip(cols, names)])


def mode_values(df: DataFrame, cols: Sequence[str]) -> list[str | None]:
    """Modes (ties -> smallest value) as driver-side strings, in one job (see ``modes``)."""
    cols = list(cols)
    if not cols:
        return []
    r = modes(df, cols, [f"m{i}" for i in range(len(cols))]).collect()[0]
    return [r[f"m{i}"] for i in range(len(cols))]


def modes(df: DataFrame, cols: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One row with the most frequent non-null value of each column; ties go to the smallest value.

    All columns share one shuffle: (column, value) pairs are counted with a
    map-side partial aggregate, so a hot value costs one row per task.
    """
    names = list(names or cols)
    idx = range(len(cols))
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("string").alias("v"))
                                          for i, c in enumerate(cols)])).alias("e")).select("e.k", "e.v")
    counts = pairs.where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("k").agg(F.min_by("v", F.struct((-F.col("cnt")).alias("c"), F.col("v"))).alias("mode"))
    return best.agg(*[F.max(F.when(F.col("k") == i, F.col("mode"))).alias(names[i]) for i in idx])
