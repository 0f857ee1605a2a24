"""AGG1-AGG13, AGG19-AGG29, AGG33: grouped and global aggregations over the outcome mart.

Every grouped aggregate is a hash aggregate with map-side partial aggregation, so
a hot key costs one partial row per task.  Global windows (``over ()``) are only
applied to already-aggregated rows (one per group of a dimension).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caremart.functions.columns import rounded, safe_div
from caremart.functions.quantiles import exact_quantiles


def _nonnull_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pandas ``groupby`` drops NULL keys; so do we."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def intervention_analysis(mart: DataFrame, by: str = "intervention_name", decimals: int | None = None) -> DataFrame:
    """AGG1: cost/outcome statistics per intervention plus cost per outcome point and efficiency.

    ``decimals=2`` reproduces the reference, which rounds the means before the
    two ratios; the default keeps them unrounded.
    """
    g = _nonnull_keys(mart, [by]).groupBy(by).agg(
        F.sum("total_cost").alias("sum_total_cost"),
        F.avg("total_cost").alias("mean_total_cost"),
        F.stddev_samp("total_cost").alias("std_total_cost"),
        F.avg("normalized_score").alias("mean_normalized_score"),
        F.stddev_samp("normalized_score").alias("std_normalized_score"),
        F.count("normalized_score").alias("count_normalized_score"),
        F.avg("improvement_from_baseline").alias("mean_improvement_from_baseline"),
        F.stddev_samp("improvement_from_baseline").alias("std_improvement_from_baseline"),
        F.avg("quality_rating").alias("mean_quality_rating"),
        F.avg("session_duration").alias("mean_session_duration"))
    if decimals is not None:
        g = g.select(*[rounded(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])
    return g.withColumns({
        "cost_per_outcome_point": safe_div("sum_total_cost", "mean_normalized_score"),
        "efficiency_ratio": safe_div("mean_improvement_from_baseline", "mean_total_cost")})


def demographic_analysis(mart: DataFrame, keys: Sequence[str] = ("age_group", "disability_category")) -> DataFrame:
    """AGG2: outcome, improvement and cost by age group x disability."""
    return _nonnull_keys(mart, keys).groupBy(*keys).agg(
        F.avg("normalized_score").alias("mean_normalized_score"),
        F.count("normalized_score").alias("count_normalized_score"),
        F.avg("improvement_from_baseline").alias("mean_improvement_from_baseline"),
        F.sum("total_cost").alias("sum_total_cost"))


def staff_analysis(mart: DataFrame, by: str = "staff_name") -> DataFrame:
    """AGG3: per staff member mean quality, outcome, improvement, duration and total cost."""
    return _nonnull_keys(mart, [by]).groupBy(by).agg(
        F.avg("quality_rating").alias("quality_rating"),
        F.avg("normalized_score").alias("normalized_score"),
        F.avg("improvement_from_baseline").alias("improvement_from_baseline"),
        F.avg("session_duration").alias("session_duration"),
        F.sum("total_cost").alias("total_cost"))


def monthly_trend(mart: DataFrame, date_col: str = "session_date") -> DataFrame:
    """AGG4: monthly means and cost (``year_month`` is the first day of the month)."""
    return (mart.where(F.col(date_col).isNotNull())
            .groupBy(F.trunc(F.col(date_col), "month").alias("year_month"))
            .agg(F.avg("normalized_score").alias("normalized_score"),
                 F.sum("total_cost").alias("total_cost"),
                 F.avg("improvement_from_baseline").alias("improvement_from_baseline"),
                 F.avg("quality_rating").alias("quality_rating")))


def quality_metrics(mart: DataFrame, records: DataFrame | None = None, threshold: float = 3) -> DataFrame:
    """AGG5: one row of quality indicators.

    The attendance rate is taken over ``records`` when given (e.g. the unfiltered
    outcome table); over the mart alone it is 100 by construction.
    """
    att_src = records if records is not None else mart
    att = att_src.agg((F.avg((F.col("attendance_status") == "attended").cast("double")) * 100)
                      .alias("overall_attendance_rate"))
    rest = mart.agg(
        F.avg("quality_rating").alias("average_quality_rating"),
        F.count_if(F.col("quality_rating") < threshold).alias("sessions_below_quality_threshold"),
        (F.avg(safe_div(F.abs("cost_variance"), "cost_per_session")) * 100).alias("cost_variance_percentage"),
        (F.avg(safe_div(F.abs("duration_variance"), "planned_duration")) * 100).alias("duration_variance_percentage"))
    return att.crossJoin(rest)  # one row x one row


def kpi_summary(mart: DataFrame) -> DataFrame:
    """AGG6: executive dashboard KPIs (cost per point is 0 when the mean outcome is not positive)."""
    g = mart.agg(F.count(F.lit(1)).alias("total_sessions"), F.sum("total_cost").alias("total_cost"),
                 F.avg("normalized_score").alias("avg_outcome"),
                 F.count_distinct("anonymous_id").alias("individuals_served"))
    return g.withColumn("cost_per_outcome", F.when(F.col("avg_outcome") > 0,
                                                   F.col("total_cost") / F.col("avg_outcome")).otherwise(F.lit(0.0)))


SEASONAL_PARTS = {
    "month": lambda c: F.month(c),
    "quarter": lambda c: F.quarter(c),
    "day_of_week": lambda c: F.weekday(c),  # Monday = 0, as pandas
}


def seasonal_profile(mart: DataFrame, part: str = "month", value: str = "normalized_score",
                     how: str = "mean", date_col: str = "session_date") -> DataFrame:
    """AGG7: mean score by calendar month, total cost by quarter, or any value by weekday."""
    agg = F.avg(value) if how == "mean" else F.sum(value)
    return (mart.where(F.col(date_col).isNotNull())
            .groupBy(SEASONAL_PARTS[part](F.col(date_col)).alias(part))
            .agg(agg.alias(value)))


def benchmark(mart: DataFrame, dim: str, decimals: int | None = None) -> DataFrame:
    """AGG8: outcome benchmark by any dimension, ranked by mean outcome (ties by name).

    ``decimals=2`` reproduces the reference, which rounds before the ratio and the ranking.
    """
    g = _nonnull_keys(mart, [dim]).groupBy(dim).agg(
        F.avg("normalized_score").alias("avg_outcome"),
        F.stddev_samp("normalized_score").alias("outcome_std"),
        F.count("normalized_score").alias("session_count"),
        F.sum("total_cost").alias("total_cost"),
        F.avg("improvement_from_baseline").alias("avg_improvement"),
        F.avg("quality_rating").alias("avg_quality"))
    if decimals is not None:
        g = g.select(*[rounded(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])
    g = g.withColumn("cost_per_outcome", safe_div("total_cost", "avg_outcome"))
    # one row per group: a global window over aggregated rows only
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("avg_outcome"), F.asc(dim))))


def underperformers(mart: DataFrame, dim: str, ratio: float = 0.8) -> DataFrame:
    """AGG9: groups whose mean outcome is below ``ratio`` x the overall mean, with the gap."""
    overall = mart.agg(F.avg("normalized_score").alias("overall_avg"))
    b = benchmark(mart, dim).crossJoin(F.broadcast(overall))  # one-row side
    return (b.where(F.col("avg_outcome") < F.col("overall_avg") * ratio)
             .select(dim, "avg_outcome", "overall_avg",
                     (F.col("overall_avg") - F.col("avg_outcome")).alias("performance_gap")))


QUADRANTS = ("High Value", "High Outcome, Low Efficiency", "Low Outcome, High Efficiency", "Needs Improvement")


def effectiveness_quadrants(mart: DataFrame, by: str = "intervention_name") -> DataFrame:
    """AGG10: per intervention means, cost effectiveness, quality-adjusted outcome and quadrant.

    Thresholds are the means over the groups (not over rows).
    """
    g = _nonnull_keys(mart, [by]).groupBy(by).agg(
        F.avg("normalized_score").alias("normalized_score"), F.avg("total_cost").alias("total_cost"),
        F.avg("improvement_from_baseline").alias("improvement_from_baseline"),
        F.avg("quality_rating").alias("quality_rating"), F.avg("session_duration").alias("session_duration"))
    g = g.withColumns({
        "cost_effectiveness": safe_div("improvement_from_baseline", "total_cost"),
        "quality_adjusted_outcome": F.col("normalized_score") * F.col("quality_rating") / 5})
    w = Window.partitionBy()  # over aggregated rows only
    g = g.withColumns({"avg_outcome_line": F.avg("quality_adjusted_outcome").over(w),
                       "avg_cost_eff_line": F.avg("cost_effectiveness").over(w)})
    hi_out = F.col("quality_adjusted_outcome") >= F.col("avg_outcome_line")
    hi_eff = F.col("cost_effectiveness") >= F.col("avg_cost_eff_line")
    return g.withColumn("quadrant", F.when(hi_out & hi_eff, QUADRANTS[0]).when(hi_out, QUADRANTS[1])
                        .when(hi_eff, QUADRANTS[2]).otherwise(QUADRANTS[3]))


def cost_effect_lines(analysis: DataFrame, name: str = "intervention_name") -> DataFrame:
    """AGG11: mean-of-means guide lines of the cost/outcome scatter and each group's side of them."""
    w = Window.partitionBy()
    a = analysis.withColumns({"avg_cost_line": F.avg("mean_total_cost").over(w),
                              "avg_outcome_line": F.avg("mean_normalized_score").over(w)})
    hi_out = F.col("mean_normalized_score") >= F.col("avg_outcome_line")
    lo_cost = F.col("mean_total_cost") <= F.col("avg_cost_line")
    label = (F.when(hi_out & lo_cost, "High outcome, low cost").when(hi_out, "High outcome, high cost")
             .when(lo_cost, "Low outcome, low cost").otherwise("Low outcome, high cost"))
    return a.select(name, "mean_total_cost", "mean_normalized_score", "avg_cost_line", "avg_outcome_line",
                    label.alias("quadrant"))


def intervention_profiles(mart: DataFrame, by: str = "intervention_name") -> DataFrame:
    """AGG12: success rate (% improving), consistency index 1 - std/mean, count and range."""
    g = _nonnull_keys(mart, [by]).groupBy(by).agg(
        (F.avg((F.col("improvement_from_baseline") > 0).cast("double")) * 100).alias("success_rate"),
        F.avg("normalized_score").alias("mean_score"), F.stddev_samp("normalized_score").alias("std_score"),
        F.count(F.lit(1)).alias("session_count"),
        F.min("normalized_score").alias("min_score"), F.max("normalized_score").alias("max_score"))
    consistency = F.when(F.col("mean_score") > 0, 1 - F.col("std_score") / F.col("mean_score")).otherwise(F.lit(0.0))
    return g.withColumn("consistency", consistency)


def describe_by(df: DataFrame, by: str | Sequence[str] | None, col: str, approx: bool = False,
                accuracy: int = 10_000) -> DataFrame:
    """AGG13: count, mean, std, min, quartiles (linear interpolation), max per group.

    Quartiles are exact (``functions.quantiles.exact_quantiles``, one path for all
    group sizes); ``approx=True`` uses bounded sketches.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    probs, names = [0.25, 0.5, 0.75], ["p25", "p50", "p75"]
    src = _nonnull_keys(df, keys)
    grouped = src.groupBy(*keys) if keys else src.groupBy()
    base = grouped.agg(F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                       F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"))
    if approx:
        qs = grouped.agg(F.percentile_approx(F.col(col).cast("double"), probs, accuracy).alias("_q"))
        qs = qs.select(*keys, *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])
    else:
        qs = exact_quantiles(src, keys, col, probs, names)
    j = base.join(qs, keys, "left") if keys else base.crossJoin(qs)  # one row x one row without keys
    return j.select(*keys, "count", "mean", "std", "min", *names, "max")


def histogram(df: DataFrame, col: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """AGG19: equal-width histogram between the global min and max (last bin closed).

    Empty bins are not emitted.  min/max come from a one-row aggregate broadcast.
    """
    src = df.where(F.col(col).isNotNull())
    rng = src.agg(F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = (src.crossJoin(F.broadcast(rng))
         .withColumn("bin", F.when(F.col("_hi") == F.col("_lo"), F.lit(0))
                     .otherwise(F.least(F.floor((F.col(col) - F.col("_lo")) / width).cast("int"), F.lit(bins - 1)))))
    keys = ([by] if by else []) + ["bin", "_lo", "_hi"]
    g = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    return g.select(*([by] if by else []), "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_start"),
                    F.when(F.col("bin") == bins - 1, F.col("_hi")).otherwise(F.col("_lo") + (F.col("bin") + 1) * w)
                    .alias("bin_end"), "count")


def executive_kpis(mart: DataFrame) -> DataFrame:
    """AGG20: report KPIs with distinct sessions and individuals."""
    return mart.agg(F.sum("total_cost").alias("total_cost"),
                    F.count_distinct("session_id").alias("total_sessions"),
                    F.count_distinct("anonymous_id").alias("unique_individuals"),
                    F.avg("normalized_score").alias("avg_outcome"))


def cost_summary(mart: DataFrame) -> DataFrame:
    """AGG21: total cost, mean per session row, mean per distinct individual."""
    g = mart.agg(F.sum("total_cost").alias("total_cost"), F.avg("total_cost").alias("avg_cost_session"),
                 F.count_distinct("anonymous_id").alias("_n"))
    return g.select("total_cost", "avg_cost_session", safe_div("total_cost", "_n").alias("avg_cost_individual"))


def cost_share(mart: DataFrame, by: str = "intervention_name") -> DataFrame:
    """AGG22/WIN10: total cost per group and its share of the overall total."""
    g = _nonnull_keys(mart, [by]).groupBy(by).agg(F.sum("total_cost").alias("total_cost"))
    return g.withColumn("share", safe_div("total_cost", F.sum("total_cost").over(Window.partitionBy())))


def cost_efficiency(analysis: DataFrame, name: str = "intervention_name", decimals: int | None = None) -> DataFrame:
    """AGG23: cost per outcome point per intervention, cheapest first."""
    return (analysis.select(name, rounded("cost_per_outcome_point", decimals).alias("cost_per_outcome_point"))
            .orderBy(F.asc_nulls_last("cost_per_outcome_point"), name))


def quality_by_staff(mart: DataFrame, by: str = "staff_name") -> DataFrame:
    """AGG24: mean quality rating per staff member, best first."""
    return (_nonnull_keys(mart, [by]).groupBy(by).agg(F.avg("quality_rating").alias("quality_rating"))
            .orderBy(F.desc("quality_rating"), by))


def individual_report(mart: DataFrame, anonymous_id: str | None = None, by: str = "intervention_name") -> DataFrame:
    """AGG25: sessions, mean score and mean improvement by intervention (one individual or all)."""
    src = mart.where(F.col("anonymous_id") == anonymous_id) if anonymous_id is not None else mart
    keys = ([] if anonymous_id is not None else ["anonymous_id"]) + [by]
    return _nonnull_keys(src, keys).groupBy(*keys).agg(
        F.count_distinct("session_id").alias("sessions"), F.avg("normalized_score").alias("avg_score"),
        F.avg("improvement_from_baseline").alias("avg_improvement"))


def staff_summary(mart: DataFrame, staff_name: str | None = None) -> DataFrame:
    """AGG26: sessions delivered, mean quality and mean outcome for one staff member (or each)."""
    if staff_name is not None:
        src, keys = mart.where(F.col("staff_name") == staff_name), []
    else:
        src, keys = _nonnull_keys(mart, ["staff_name"]), ["staff_name"]
    return src.groupBy(*keys).agg(F.count_distinct("session_id").alias("sessions_delivered"),
                                  F.avg("quality_rating").alias("avg_quality_rating"),
                                  F.avg("normalized_score").alias("avg_outcome_score"))


def service_summary(mart: DataFrame) -> DataFrame:
    """AGG27: rows, distinct individuals and service hours (minutes / 60)."""
    return mart.agg(F.count(F.lit(1)).alias("total_sessions"),
                    F.count_distinct("anonymous_id").alias("unique_individuals"),
                    (F.sum("session_duration") / 60).alias("total_service_hours"))


def goal_compliance(mart: DataFrame, goals: DataFrame, status: str = "active") -> DataFrame:
    """AGG28: % individuals with an active goal over individuals served in the mart.

    As in the reference, the numerator ignores the period, so it may exceed 100.
    """
    num = goals.where(F.col("status") == status).agg(F.count_distinct("individual_id").alias("with_goals"))
    den = mart.agg(F.count_distinct("anonymous_id").alias("served"))
    return num.crossJoin(den).select(  # one row x one row
        "with_goals", "served",
        F.when(F.col("served") > 0, F.col("with_goals") / F.col("served") * 100).otherwise(F.lit(0.0))
        .alias("goal_compliance"))


def notes_compliance(mart: DataFrame, min_len: int = 10) -> DataFrame:
    """AGG29: % of rows whose notes are longer than ``min_len`` characters."""
    g = mart.agg(F.count_if(F.length("notes") > min_len).alias("with_notes"), F.count(F.lit(1)).alias("rows"))
    return g.withColumn("notes_compliance", F.when(F.col("rows") > 0, F.col("with_notes") / F.col("rows") * 100)
                        .otherwise(F.lit(0.0)))


def presence_matrix(df: DataFrame, row: str, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """AGG39: row key x column key pivot, True where a pair occurs, False elsewhere.

    Pass ``values`` (the column keys) to avoid the extra distinct job pivot runs;
    a key of the data that is not listed raises, it does not vanish.
    """
    src = df
    if values is not None:
        known = F.col(col).isin(list(values)) | F.col(col).isNull()
        message = F.concat(F.lit(f"presence_matrix: unlisted {col} "), F.col(col).cast("string"))
        src = df.withColumn(col, F.when(known, F.col(col)).otherwise(F.raise_error(message)))
    p = src.groupBy(row).pivot(col, list(values) if values is not None else None).agg(F.bool_or(F.lit(True)))
    return p.fillna(False, subset=[c for c in p.columns if c != row])


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """AGG33: row count per table as one union of global counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
