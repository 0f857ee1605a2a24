"""AGG14-AGG18, JN2-JN4, JN6-JN7, GOL1, SCH1-SCH2, AGG36: individual progress, goals and schedules.

Per-individual work is grouped by the individual's key (hash aggregates and
key-partitioned windows); the reference's N+1 lookups (one query per goal,
per metric, per row) become joins.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.functions.columns import clamp, safe_div
from caremart.functions.prefix import row_index

WHO = "anonymous_id"


def _when_order(date_col: str = "session_date", tie: str = "id"):
    return F.struct(F.col(date_col), F.col(tie))


def individual_summary(mart: DataFrame, by: str = WHO) -> DataFrame:
    """AGG14: sessions, distinct interventions, mean/first/latest outcome and change, cost, attendance, quality."""
    o = _when_order()
    return (mart.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_distinct("intervention_name").alias("active_interventions"),
        F.avg("normalized_score").alias("avg_outcome"),
        F.max_by("normalized_score", o).alias("latest_outcome"),
        F.min_by("normalized_score", o).alias("first_outcome"),
        F.sum("total_cost").alias("total_investment"),
        F.avg("total_cost").alias("avg_session_cost"),
        (F.avg((F.col("attendance_status") == "attended").cast("double")) * 100).alias("attendance_rate"),
        F.avg("quality_rating").alias("avg_quality"))
        .withColumn("outcome_change", F.col("latest_outcome") - F.col("first_outcome")))


def progress_summary(mart: DataFrame, keys: Sequence[str] = (WHO, "intervention_name", "metric_name")) -> DataFrame:
    """AGG15: first, latest (chronological), mean, count, last improvement and change per key."""
    o = _when_order()
    g = mart.groupBy(*keys).agg(
        F.min_by("normalized_score", o).alias("first_score"),
        F.max_by("normalized_score", o).alias("latest_score"),
        F.avg("normalized_score").alias("avg_score"),
        F.count("normalized_score").alias("sessions"),
        F.max_by("improvement_from_baseline", o).alias("total_improvement"))
    return g.withColumn("change", F.col("latest_score") - F.col("first_score"))


def individual_effectiveness(mart: DataFrame, keys: Sequence[str] = (WHO, "intervention_name")) -> DataFrame:
    """AGG16: per individual and intervention outcome stats, improvement, cost and cost per improvement."""
    g = mart.groupBy(*keys).agg(
        F.avg("normalized_score").alias("avg_outcome"), F.stddev_samp("normalized_score").alias("outcome_std"),
        F.count("normalized_score").alias("session_count"),
        F.avg("improvement_from_baseline").alias("avg_improvement"),
        F.sum("improvement_from_baseline").alias("total_improvement"),
        F.sum("total_cost").alias("total_cost"), F.avg("quality_rating").alias("avg_quality"),
        F.avg("session_duration").alias("avg_duration"))
    return g.withColumn("cost_per_improvement", safe_div("total_cost", "total_improvement"))


def recommendations(eff: DataFrame, by: str = WHO, name: str = "intervention_name") -> DataFrame:
    """AGG17: per individual the most effective, most used and most cost-effective intervention.

    Ties go to the alphabetically first name (first row of a name-sorted group).
    """
    n = F.col(name)
    return eff.groupBy(by).agg(
        F.min_by(name, F.when(F.col("avg_improvement").isNotNull(),
                              F.struct((-F.col("avg_improvement")).alias("k"), n))).alias("most_effective"),
        F.min_by(name, F.struct((-F.col("session_count")).alias("k"), n)).alias("most_utilized"),
        F.min_by(name, F.when(F.col("cost_per_improvement").isNotNull(),
                              F.struct(F.col("cost_per_improvement").alias("k"), n))).alias("most_cost_effective"))


def individual_detail(mart: DataFrame, by: str = WHO) -> DataFrame:
    """AGG18/STA10: consistency, monthly trend (slope over session index x 30), duration compliance,
    quality consistency, cost per improvement and ROI % per individual."""
    # session index per individual without sorting a whole individual in one task
    src = row_index(mart.where(F.col(by).isNotNull()), [by], ["session_date", "id"], "_idx",
                    keep=["normalized_score", "session_duration", "planned_duration", "quality_rating", "total_cost",
                          "improvement_from_baseline"]).withColumn("_idx", F.col("_idx").cast("double"))
    g = src.groupBy(by).agg(
        F.avg("normalized_score").alias("_m"), F.stddev_samp("normalized_score").alias("_s"),
        F.regr_slope("normalized_score", "_idx").alias("_slope"),
        F.avg(safe_div("session_duration", "planned_duration")).alias("duration_compliance"),
        F.avg("quality_rating").alias("_qm"), F.stddev_samp("quality_rating").alias("_qs"),
        F.sum("total_cost").alias("_cost"), F.sum("improvement_from_baseline").alias("_imp"))
    return g.select(
        by,
        (1 - safe_div("_s", "_m")).alias("consistency_index"),
        (F.col("_slope") * 30).alias("monthly_trend"),
        "duration_compliance",
        (1 - safe_div("_qs", "_qm")).alias("quality_consistency"),
        F.when(F.col("_imp") > 0, F.col("_cost") / F.col("_imp")).otherwise(F.lit(0.0)).alias("cost_per_improvement"),
        F.when(F.col("_cost") > 0, F.col("_imp") / F.col("_cost") * 100).otherwise(F.lit(0.0)).alias("roi_percentage"))


# --------------------------------------------------------------------------- goals
def goals_with_metrics(goals: DataFrame, metrics: DataFrame) -> DataFrame:
    """JN2: goals with their metric's name and direction, ordered by priority then target date."""
    m = metrics.select(F.col("id").alias("_mid"), F.col("name").alias("metric_name"), "higher_is_better")
    return (goals.join(m, goals.outcome_metric_id == m._mid).drop("_mid")
            .orderBy("individual_id", "priority_level", "target_date", "id"))


def latest_score(outcomes: DataFrame, keys: Sequence[str] = ("individual_id", "outcome_metric_id"),
                 order: Sequence[str] = ("session_date", "created_at", "id"), out: str = "latest_score") -> DataFrame:
    """JN3/WIN7: newest score per key (one hash aggregate instead of one query per goal)."""
    return outcomes.groupBy(*keys).agg(F.max_by("score", F.struct(*order)).alias(out))


def baseline_score(outcomes: DataFrame, keys: Sequence[str] = ("individual_id", "outcome_metric_id"),
                   order: Sequence[str] = ("session_date", "created_at", "id"), out: str = "first_score") -> DataFrame:
    """JN4: first score per key, the fallback baseline."""
    return outcomes.groupBy(*keys).agg(F.min_by("score", F.struct(*order)).alias(out))


def goal_progress(goals: DataFrame, metrics: DataFrame, outcomes: DataFrame, as_of: _dt.date) -> DataFrame:
    """GOL1: direction-aware progress % (clamped 0-100), days remaining and a traffic-light status.

    The current value is the latest score (else the baseline).  A missing baseline
    falls back to the first score; target == baseline gives NULL progress.
    """
    g = goals_with_metrics(goals, metrics)
    keys = ["individual_id", "outcome_metric_id"]
    sc = outcomes.groupBy(*keys).agg(
        F.max_by("score", F.struct("session_date", "created_at", "id")).alias("latest_score"),
        F.min_by("score", F.struct("session_date", "created_at", "id")).alias("first_score"))
    j = g.join(sc, keys, "left")
    base = F.coalesce(F.col("baseline_value").cast("double"), F.col("first_score").cast("double"))
    cur = F.coalesce(F.col("latest_score").cast("double"), base)
    tgt = F.col("target_value").cast("double")
    raw = F.when(F.coalesce(F.col("higher_is_better"), F.lit(False)), safe_div(cur - base, tgt - base) * 100) \
        .otherwise(safe_div(base - cur, base - tgt) * 100)
    prog = clamp(raw, 0.0, 100.0)
    return j.select(
        "id", "individual_id", "outcome_metric_id", "metric_name", "goal_type", "priority_level", "status",
        base.alias("baseline_value"), tgt.alias("target_value"), cur.alias("current_value"),
        prog.alias("progress"),
        F.datediff(F.col("target_date"), F.lit(as_of)).alias("days_remaining"),
        F.when(prog >= 80, "green").when(prog >= 50, "orange").when(prog.isNotNull(), "red").alias("status_color"))


# --------------------------------------------------------------------------- schedules
# Days to the next assessment for each schedule frequency.
FREQUENCY_DAYS = {"Weekly": 7, "Bi-Weekly": 14, "Monthly": 30, "Quarterly": 90}


def next_due(df: DataFrame, start: str = "start_date", frequency: str = "frequency",
             out: str = "next_due_date") -> DataFrame:
    """SCH1: next due date = start + 7/14/30/90 days by frequency (NULL for an unknown one)."""
    days = F.create_map(*[x for k, v in FREQUENCY_DAYS.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out, F.date_add(F.col(start), days[F.col(frequency)]))


def schedule_list(schedules: DataFrame, individuals: DataFrame, metrics: DataFrame,
                  as_of: _dt.date | None = None) -> DataFrame:
    """JN7/SCH2: schedules with individual and metric names ordered by due date; overdue flag vs ``as_of``."""
    i = individuals.select(F.col("id").alias("_iid"), "anonymous_id")
    m = metrics.select(F.col("id").alias("_mid"), F.col("name").alias("metric_name"))
    # several schedules for each individual: their estimated size is that of the rows they are exploded from, so
    # without the hint millions of schedules are gathered in the driver as the smaller side
    j = (schedules.join(i.hint("merge"), schedules.individual_id == i._iid).join(m, schedules.outcome_metric_id == m._mid)
         .select(schedules.id, "anonymous_id", "metric_name", "frequency", "next_due_date"))
    if as_of is not None:
        j = j.withColumns({"days_overdue": F.datediff(F.lit(as_of), F.col("next_due_date")),
                           "overdue": F.col("next_due_date") < F.lit(as_of)})
    return j.orderBy("next_due_date", "id")


# --------------------------------------------------------------------------- staff activity
def staff_activity(outcomes: DataFrame, interventions: DataFrame, metrics: DataFrame, individuals: DataFrame,
                   since: _dt.date, recorder: str | None = None, recorder_col: str = "staff_id") -> DataFrame:
    """JN6: sessions recorded since a date with intervention, metric and individual names.

    ``recorder=None`` keeps every recorder (one row per session, keyed by recorder).
    """
    o = outcomes.where(F.col("session_date") >= F.lit(since))
    if recorder is not None:
        o = o.where(F.col(recorder_col) == F.lit(recorder))
    i = interventions.select(F.col("id").alias("_iid"), F.col("name").alias("intervention_name"))
    m = metrics.select(F.col("id").alias("_mid"), F.col("name").alias("metric_name"))
    p = individuals.select(F.col("id").alias("_pid"), "anonymous_id")
    return (o.join(i, o.intervention_id == i._iid).join(m, o.outcome_metric_id == m._mid)
             .join(p, o.individual_id == p._pid).drop("_iid", "_mid", "_pid"))


def staff_dashboard(activity: DataFrame, as_of: _dt.date, by: str = "staff_id", week_days: int = 7) -> DataFrame:
    """AGG36: distinct sessions (period), individuals, mean quality, distinct sessions in the last week."""
    week = F.col("session_date") >= F.lit(as_of - _dt.timedelta(days=week_days))
    return activity.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count_distinct("session_id").alias("sessions_period"),
        F.count_distinct("anonymous_id").alias("individuals_served"),
        F.avg("quality_rating").alias("avg_quality_rating"),
        F.count_distinct(F.when(week, F.col("session_id"))).alias("sessions_this_week"))
