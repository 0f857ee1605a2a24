"""WIN1-WIN11, SRT1-SRT2: rankings, top-k, first/last and ordered views.

Per-key windows are partitioned by the key; a global window is only used on
rows that are already aggregated to one per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caremart.plans.materialize import write_stage


SALT_BUCKETS = 64


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  salt_buckets: int = SALT_BUCKETS, tie: str | None = None, out: str | None = None) -> DataFrame:
    """The first ``n`` rows per key by ``order``, safe for a key holding a third of all rows.

    Spark limits ``row_number() <= n`` before the shuffle (each task keeps its own
    first ``n`` of a key), so a hot key sends ``n`` rows per task to its window.
    ``out`` names a column holding the final rank (1..n).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    res = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return res.withColumnRenamed("_rank", out) if out else res.drop("_rank")


def _order(col: str, desc: bool) -> Column:
    return F.desc_nulls_last(col) if desc else F.asc_nulls_last(col)


def rank_by(df: DataFrame, col: str, desc: bool = True, tie: str | Sequence[str] = "intervention_name",
            out: str = "rank") -> DataFrame:
    """WIN1: 1..n ranking (row_number, as ``range(1, n+1)``) with an explicit tie-breaker."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    return df.withColumn(out, F.row_number().over(Window.orderBy(_order(col, desc), *[F.asc(t) for t in ties])))


def top_k(df: DataFrame, col: str, k: int = 10, desc: bool = True, tie: str | Sequence[str] = ()) -> DataFrame:
    """WIN2: the first k rows by ``col`` (a top-k report: the limit is the feature)."""
    ties = [tie] if isinstance(tie, str) else list(tie)
    return df.orderBy(_order(col, desc), *ties).limit(k)


def top_bottom(df: DataFrame, col: str, name: str = "intervention_name", top: int = 3,
               bottom: int = 2) -> DataFrame:
    """WIN3: names of the best ``top`` and worst ``bottom`` rows joined by ', ' (best first in each list)."""
    w_top = Window.orderBy(F.desc_nulls_last(col), F.asc(name))
    w_bot = Window.orderBy(F.asc_nulls_first(col), F.desc(name))
    r = df.select(name, col, F.row_number().over(w_top).alias("_rt"), F.row_number().over(w_bot).alias("_rb"))
    return r.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_rt") <= top, F.struct("_rt", name)))),
                                 lambda s: s[name]), ", ").alias("top_performers"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_rb") <= bottom,
                                                                    F.struct((-F.col("_rb")).alias("o"), name)))),
                                 lambda s: s[name]), ", ").alias("bottom_performers"))


def recent_vs_early(df: DataFrame, by: str | Sequence[str], order: str = "session_date",
                    value: str = "normalized_score", k: int = 10, threshold: float = 0.5,
                    tie: str = "id") -> DataFrame:
    """WIN5: mean of the latest k vs the earliest k values per key (only keys with more than k rows).

    Verdict: improving above +threshold, declining below -threshold, else stable.
    """
    keys = [by] if isinstance(by, str) else list(by)
    # the pruned projection is written once: the counts and the two top-k lists scan it
    src = write_stage(df.select(*keys, order, tie, value), "recent-vs-early")
    # the k newest and the k oldest per key; each top-k is limited before its shuffle
    none = F.lit(None).cast("double")
    allr = src.select(*keys, F.lit(1).alias("_c"), none.alias("_new"), none.alias("_old"))
    new = top_n_per_key(src, keys, [F.desc(order), F.desc(tie)], k).select(
        *keys, F.lit(0).alias("_c"), F.col(value).cast("double").alias("_new"), none.alias("_old"))
    old = top_n_per_key(src, keys, [F.asc(order), F.asc(tie)], k).select(
        *keys, F.lit(0).alias("_c"), none.alias("_new"), F.col(value).cast("double").alias("_old"))
    # one aggregate over the union (a NULL key stays its own group, no join needed)
    g = allr.unionByName(new).unionByName(old).groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.avg("_new").alias("recent_avg"), F.avg("_old").alias("early_avg"))
    g = g.where(F.col("n") > k).withColumn("trend", F.col("recent_avg") - F.col("early_avg"))
    return g.withColumn("verdict", F.when(F.col("trend") > threshold, "improving")
                        .when(F.col("trend") < -threshold, "declining").otherwise("stable"))


def recent_activity(df: DataFrame, by: str | Sequence[str] = "staff_id", order: str = "session_date",
                    n: int = 10, tie: str = "id") -> DataFrame:
    """WIN6: the latest ``n`` rows per key (per-key top-n; the cap is the feature)."""
    keys = [by] if isinstance(by, str) else list(by)
    return top_n_per_key(df, keys, [F.desc(order), F.desc(tie)], n)


def progress_timeline(mart: DataFrame, metrics: Sequence[str] | None = None,
                      cols: Sequence[str] = ("anonymous_id", "session_date", "intervention_name", "metric_name",
                                             "normalized_score", "score")) -> DataFrame:
    """WIN11: per-metric progress series, optionally restricted to some metrics, ordered by date."""
    src = mart.where(F.col("metric_name").isin(list(metrics))) if metrics else mart
    return src.select(*cols).orderBy("anonymous_id", "metric_name", "session_date")


def service_log(mart: DataFrame, cols: Sequence[str] = ("session_date", "anonymous_id", "intervention_name",
                                                        "session_duration", "staff_name", "recorded_by",
                                                        "created_at", "id"),
                ascending: bool = True) -> DataFrame:
    """SRT1: the service delivery log ordered by date (then id, for a total order)."""
    o = F.asc("session_date") if ascending else F.desc("session_date")
    return mart.select(*cols).orderBy(o, "id")
