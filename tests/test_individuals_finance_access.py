"""Goals, budget proration, recent-vs-early, lock-outs (batch and streaming twin)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from caremart.operators import access as AC
from caremart.operators import finance as FN
from caremart.operators import individuals as I
from caremart.operators import ranking as R


def test_goal_progress_lower_better_and_degenerate(spark):
    goals = spark.createDataFrame([("g1", "p", "m", 8.0, 4.0, dt.date(2020, 2, 1), 1, "active", "Improvement"),
                                   ("g2", "p", "m2", 5.0, 5.0, dt.date(2020, 2, 1), 2, "active", "Improvement")],
                                  "id string, individual_id string, outcome_metric_id string, baseline_value double, "
                                  "target_value double, target_date date, priority_level int, status string, "
                                  "goal_type string")
    metrics = spark.createDataFrame([("m", "M", False), ("m2", "M2", True)], "id string, name string, "
                                    "higher_is_better boolean")
    outcomes = spark.createDataFrame([("o1", "p", "m", 6.0, dt.date(2020, 1, 5), dt.datetime(2020, 1, 5))],
                                     "id string, individual_id string, outcome_metric_id string, score double, "
                                     "session_date date, created_at timestamp_ntz")
    got = {r["id"]: r for r in I.goal_progress(goals, metrics, outcomes, dt.date(2020, 1, 10)).collect()}
    assert got["g1"]["progress"] == pytest.approx(50.0)
    assert got["g1"]["status_color"] == "orange" and got["g1"]["days_remaining"] == 22
    assert got["g2"]["progress"] is None


def test_budget_proration_leap_year(spark):
    budgets = spark.createDataFrame([(2024, 366.0)], "fiscal_year int, total_budget double")
    costs = spark.createDataFrame([(dt.date(2024, 1, 5), 1.0, 1.0, 1.0, None)],
                                  "cost_date date, direct_cost double, indirect_cost double, overhead_cost double, "
                                  "material_cost double")
    r = FN.budget_vs_actual(costs, budgets, dt.date(2024, 1, 1), dt.date(2024, 1, 31)).collect()[0]
    assert r["prorated_budget"] == pytest.approx(31.0)
    assert r["actual_spending"] == 0.0  # a NULL part drops the row, as the reference SQL
    r2 = FN.budget_vs_actual(costs, budgets, dt.date(2024, 1, 1), dt.date(2024, 1, 31), null_as_zero=True).collect()[0]
    assert r2["actual_spending"] == 3.0


def test_recent_vs_early(spark):
    rows = [("s", dt.date(2020, 1, i + 1), f"r{i:02d}", 1.0 if i < 10 else 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "staff_id string, session_date date, id string, score double")
    r = R.recent_vs_early(df, "staff_id", "session_date", "score", 10).collect()[0]
    assert r["trend"] == pytest.approx(1.0) and r["verdict"] == "improving"


def _events(spark, pattern):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 7, base + dt.timedelta(minutes=i), c == "F") for i, c in enumerate(pattern)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, failed boolean")


def test_lockout_batch(spark):
    r = AC.lockouts(_events(spark, "FFSFFF")).collect()[0]
    assert r["account_locked"] and r["login_attempts"] == 3
    assert r["locked_at"] == dt.datetime(2024, 1, 1, 0, 5)
    r2 = AC.lockouts(_events(spark, "FFSFS")).collect()[0]
    assert not r2["account_locked"] and r2["login_attempts"] == 0


def test_lockout_stream_matches_batch(spark, tmp_path):
    from caremart.streaming import jobs as SJ
    ev = _events(spark, "FFSFFFSF").withColumn("ts", F.col("ts").cast("timestamp"))
    src_dir = str(tmp_path / "in")
    ev.write.parquet(src_dir)
    stream = spark.readStream.schema(ev.schema).parquet(src_dir)
    out = SJ.stream_lockouts(stream, out_dir=str(tmp_path / "out"), checkpoint=str(tmp_path / "ck"))
    s = SJ.lockout_state(spark, out).collect()[0]
    b = AC.lockouts(_events(spark, "FFSFFFSF")).collect()[0]
    assert (s["account_locked"], s["login_attempts"]) == (b["account_locked"], b["login_attempts"])


def test_fiscal_year_start_month(spark):
    budgets = spark.createDataFrame([(2023, 100.0), (2024, 100.0)], "fiscal_year int, total_budget double")
    costs = spark.createDataFrame([(dt.date(2024, 3, 1), 10.0, 0.0, 0.0, 0.0), (dt.date(2024, 8, 1), 5.0, 0.0, 0.0, 0.0)],
                                  "cost_date date, direct_cost double, indirect_cost double, overhead_cost double, "
                                  "material_cost double")
    cal = {r["fiscal_year"]: r["ytd_spending"] for r in FN.budget_status(costs, budgets).collect()}
    assert cal == {2023: 0.0, 2024: 15.0}
    july = {r["fiscal_year"]: r["ytd_spending"] for r in FN.budget_status(costs, budgets, start_month=7).collect()}
    assert july == {2023: 10.0, 2024: 5.0}


def test_exploded_schedules_are_not_broadcast(spark, tmp_path):
    """Schedules look as small as the individuals they are exploded from, and are many times as many."""
    spark.range(20_000).withColumnRenamed("id", "key").write.parquet(str(tmp_path / "people"))
    people = spark.read.parquet(str(tmp_path / "people"))
    schedules = people.select(
        "key", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("outcome_metric_id")).select(
        (F.col("key") * 100 + F.col("outcome_metric_id")).alias("id"), F.col("key").alias("individual_id"),
        "outcome_metric_id", F.lit("Weekly").alias("frequency"), F.lit(dt.date(2024, 1, 1)).alias("start_date"))
    individuals = people.join(people.select(F.col("key").alias("other")), F.col("key") == F.col("other")).select(
        F.col("key").alias("id"), F.col("key").cast("string").alias("anonymous_id"))
    metrics = spark.range(1, 41).select(F.col("id").cast("int").alias("id"), F.lit("m").alias("name"))
    listed = I.schedule_list(I.next_due(schedules), individuals, metrics)
    plan = listed._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "individual_id" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), plan
    assert listed.count() == 800_000
