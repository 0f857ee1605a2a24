"""AGG30-AGG32, FLT10, LOC1: login activity, security counters, record growth, alerts and lock-outs.

Lock-out detection is a gaps-and-islands computation over each user's event
sequence: successes start a new island, failures are counted within it, and the
first island reaching the limit locks the account.  Events are range-partitioned
by user and time, so one very active user is not one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caremart.plans.materialize import write_stage


def login_activity(logins: DataFrame, as_of: _dt.date, days: int = 30, ts: str = "ts",
                   user: str = "user_id") -> DataFrame:
    """AGG30: successful logins per day over the last ``days`` days: count and distinct users."""
    since = as_of - _dt.timedelta(days=days)
    ok = logins.where(~F.col("failed") & (F.col(ts) >= F.lit(since)))
    return ok.groupBy(F.to_date(ts).alias("login_date")).agg(
        F.count(F.lit(1)).alias("login_count"), F.count_distinct(user).alias("unique_users"))


SKETCH_BITS = 14  # 2^14 registers of a sketch, 16 KB at most
SKETCH_ERROR = 0.03  # three standard errors and more: the standard error is 1.04 / sqrt(2^14) = 0.8 %


def daily_user_sketches(events: DataFrame, ts: str = "ts", user: str = "user_id", bits: int = SKETCH_BITS) -> DataFrame:
    """AGG30: ``day, sketch``, a HyperLogLog sketch of each day's users, to be stored and merged for any period."""
    return events.where(F.col(user).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(
        F.hll_sketch_agg(F.col(user).cast("string"), F.lit(bits)).alias("sketch"))


def merge_sketches(sketches: DataFrame, *keys) -> DataFrame:
    """The keys and the merged ``sketch`` of their rows; merging is associative, events are not read again."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def merged_users(sketches: DataFrame, *keys) -> DataFrame:
    """The keys and ``estimate``, the approximate number of distinct users of their sketches together."""
    merged = merge_sketches(sketches, *keys)
    return merged.select(*[c for c in merged.columns if c != "sketch"], F.hll_sketch_estimate("sketch").alias("estimate"))


def lockouts(events: DataFrame, limit: int = 3, user: str = "user_id", ts: str = "ts",
             order_tie: str = "event_id") -> DataFrame:
    """LOC1: final login state per user from an event table of (user, ts, failed).

    A failure adds one attempt; ``limit`` attempts lock the account and later
    events are ignored; a success before that resets the attempts to 0.

    Gaps and islands in one pass, without a per-user sort: events are range-
    partitioned by (user, time), so a user with a third of the events is split over
    many tasks.  Failures since the last success and the time of that success are
    running values inside a partition; what earlier partitions of the user hand on
    (a small row per user and partition) is added to the events before the
    partition's first success.  One hash aggregate then takes the first event that
    reaches the limit.
    """
    e = events.select(user, ts, order_tie, F.col("failed").cast("boolean").alias("failed"))
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = write_stage(e.repartitionByRange(n, user, ts, order_tie).withColumn("_pid", F.spark_partition_id()), "lockouts")
    upto = (Window.partitionBy("_pid", user).orderBy(ts, order_tie)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    e = e.withColumn("_fails", F.sum(F.col("failed").cast("long")).over(upto)).withColumns({
        "_at_success": F.max(F.when(~F.col("failed"), F.col("_fails"))).over(upto),
        "_success": F.max(F.when(~F.col("failed"), F.col(ts))).over(upto)})
    parts = e.groupBy("_pid", user).agg(F.max("_fails").alias("_total"), F.max("_at_success").alias("_base"),
                                        F.max("_success").alias("_seen"))
    in_order = Window.partitionBy(user).orderBy("_pid")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_sum", F.sum("_total").over(in_order))
    # failures of all partitions up to the last success in an earlier one
    parts = parts.withColumns({
        "_carry": F.coalesce(F.col("_sum") - F.col("_total") - F.coalesce(F.max(
            F.when(F.col("_base").isNotNull(), F.col("_sum") - F.col("_total") + F.col("_base"))).over(before), F.lit(0)),
            F.lit(0)),
        "_seen_before": F.max("_seen").over(before)})
    end = parts.withColumn("_end", F.when(F.col("_base").isNotNull(), F.col("_total") - F.col("_base"))
                           .otherwise(F.col("_carry") + F.col("_total")))
    end = end.groupBy(user).agg(F.max_by("_end", "_pid").alias("_last_run"))
    e = e.join(parts.select("_pid", user, "_carry", "_seen_before"), ["_pid", user])
    run = F.col("_fails") + F.when(F.col("_at_success").isNotNull(), -F.col("_at_success")).otherwise(F.col("_carry"))
    hit = F.col("failed") & (run == limit)
    never = F.lit("0001-01-01 00:00:00").cast(events.schema[ts].dataType)
    # the last success only moves on, so the smallest one of all hits belongs to the first
    g = e.groupBy(user).agg(
        F.min(F.when(hit, F.col(ts))).alias("locked_at"),
        F.min(F.when(hit, F.coalesce(F.col("_success"), F.col("_seen_before"), never))).alias("_login"),
        F.max(F.when(~F.col("failed"), F.col(ts))).alias("_last_success"), F.count(F.lit(1)).alias("events"))
    locked = F.col("locked_at").isNotNull()
    return (g.join(end, user).select(
        user, locked.alias("account_locked"),
        F.when(locked, F.lit(limit)).otherwise(F.col("_last_run")).cast("int").alias("login_attempts"), "locked_at",
        F.when(locked, F.nullif(F.col("_login"), never)).otherwise(F.col("_last_success")).alias("last_login"), "events"))


def users_from_logins(logins: DataFrame, limit: int = 3, password_days: int = 21) -> DataFrame:
    """A users table derived from login events: lock-out state plus a password expiry after the first event."""
    first = logins.groupBy("user_id").agg(F.min("ts").alias("_first"))
    return (lockouts(logins, limit).join(first, "user_id")
            .withColumns({"password_expires": F.col("_first") + F.expr(f"INTERVAL {password_days} DAYS"),
                          "active": F.lit(True)}).drop("_first"))


def security_summary(users: DataFrame, as_of: _dt.date, inactive_days: int = 30) -> DataFrame:
    """AGG31: locked accounts, accounts with failed attempts, expired passwords and inactive users."""
    act = F.coalesce(F.col("active"), F.lit(False))
    return users.agg(
        F.count_if(F.col("account_locked")).alias("locked_accounts"),
        F.count_if(F.col("login_attempts") > 0).alias("failed_attempts"),
        F.count_if((F.col("password_expires") < F.lit(as_of)) & act).alias("expired_passwords"),
        F.count_if((F.col("last_login") < F.lit(as_of - _dt.timedelta(days=inactive_days))) & act)
        .alias("inactive_users"))


def record_growth(records: DataFrame, as_of: _dt.date, months: int = 12, col: str = "created_at",
                  trailing: int = 3) -> DataFrame:
    """AGG32/WIN9: new records per month over the last ``months`` months with a trailing mean."""
    since = F.add_months(F.lit(as_of), -months)
    g = (records.where(F.col(col) >= since).groupBy(F.trunc(F.col(col), "month").alias("month"))
         .agg(F.count(F.lit(1)).alias("new_records")))
    # a dozen monthly rows: a global window over aggregated rows only
    return g.withColumn("trailing_mean", F.avg("new_records").over(
        Window.orderBy("month").rowsBetween(-(trailing - 1), 0)))


# Severity order (highest first) used to rank alerts.
SEVERITY_RANK = {"error": 3, "warning": 2, "info": 1}


def active_alerts(alerts: DataFrame, user: str | None, role: str | None, as_of, n: int = 5,
                  severity_as_text: bool = False) -> DataFrame:
    """FLT10: unread, unexpired alerts for a user, their role or everyone; top ``n`` by severity, newest.

    Severity ranks error > warning > info (``severity_as_text`` keeps the text order).
    """
    ts = F.lit(as_of).cast("timestamp_ntz")
    mine = ((F.col("target_user") == F.lit(user)) | (F.col("target_role") == F.lit(role))
            | (F.col("target_user").isNull() & F.col("target_role").isNull()))
    a = alerts.where(F.coalesce(mine, F.lit(False)) & ~F.col("is_read") & (F.col("expires_at") > ts))
    rank = F.col("severity") if severity_as_text else \
        F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])[F.col("severity")]
    return a.orderBy(F.desc_nulls_last(rank), F.desc("created_at"), "title").limit(n)
