"""DQ1-DQ6, JN5, AGG34-AGG35, RUL1: data-quality checks, dedupe and rule scoring.

Duplicate handling aggregates by the duplicate key (map-side partial
aggregation) instead of sorting whole groups, so a key holding a third of the
rows still reduces to one row per task before the shuffle.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DUP_KEYS = ("individual_id", "intervention_id", "session_date")


def _scaled(records: DataFrame, metrics: DataFrame) -> DataFrame:
    m = metrics.select(F.col("id").alias("_mid"), F.col("name").alias("metric_name"),
                       F.col("scale_min").cast("double").alias("scale_min"),
                       F.col("scale_max").cast("double").alias("scale_max"))
    return records.join(m, records.outcome_metric_id == m._mid).drop("_mid")


def _invalid(df: DataFrame) -> "F.Column":
    return (F.col("score") < F.col("scale_min")) | (F.col("score") > F.col("scale_max"))


def dq_overview(records: DataFrame, metrics: DataFrame, as_of: _dt.date,
                keys: Sequence[str] = DUP_KEYS) -> DataFrame:
    """DQ1: one row with duplicate rows (sum of count-1 per key), out-of-scale scores and future dates."""
    dups = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))
    inv = _scaled(records, metrics).agg(F.count_if(_invalid(records)).alias("invalid_scores"))
    fut = records.agg(F.count_if(F.col("session_date") > F.lit(as_of)).alias("future_dates"))
    return dups.crossJoin(inv).crossJoin(fut)  # three one-row frames


def duplicate_groups(records: DataFrame, keys: Sequence[str] = DUP_KEYS, n: int | None = 10) -> DataFrame:
    """DQ2: keys with more than one row, most duplicated first (the top-n list is the feature)."""
    g = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    g = g.orderBy(F.desc("count"), *keys)
    return g.limit(n) if n else g


def dedupe_keep_first(records: DataFrame, keys: Sequence[str] = DUP_KEYS,
                      order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """DQ3: keep the first row of each duplicate key by ``order`` (idempotent).

    Spark limits ``row_number() <= 1`` before the shuffle, so a hot key sends one
    row per task, and only the selected columns are read.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return records.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def removed_duplicates(records: DataFrame, keys: Sequence[str] = DUP_KEYS,
                       order: Sequence[str] = ("created_at", "id"), id_col: str = "id") -> DataFrame:
    """DQ3/UPD5: ids that a keep-first merge deletes (for logs; to delete them, keep ``dedupe_keep_first``)."""
    return records.select(id_col).join(dedupe_keep_first(records, keys, order).select(id_col), id_col, "left_anti")


def invalid_scores(records: DataFrame, metrics: DataFrame, individuals: DataFrame, interventions: DataFrame,
                   n: int | None = None) -> DataFrame:
    """JN5/DQ4: out-of-scale scores with names (4-way join + range predicate); ordered by id."""
    s = _scaled(records, metrics).where(_invalid(records))
    p = individuals.select(F.col("id").alias("_pid"), "anonymous_id")
    i = interventions.select(F.col("id").alias("_iid"), F.col("name").alias("intervention"))
    out = (s.join(p, s.individual_id == p._pid).join(i, s.intervention_id == i._iid)
           .select("id", "anonymous_id", "intervention", F.col("metric_name").alias("metric"), "score",
                   "scale_min", "scale_max").orderBy("id"))
    return out.limit(n) if n else out


def future_list(records: DataFrame, as_of: _dt.date, n: int | None = None) -> DataFrame:
    """DQ5: future-dated records, ordered by id."""
    out = (records.where(F.col("session_date") > F.lit(as_of))
           .select("id", "individual_id", "intervention_id", "session_date").orderBy("id"))
    return out.limit(n) if n else out


def days_since_valid(records: DataFrame, as_of: _dt.date, col: str = "session_date") -> DataFrame:
    """AGG35: days between ``as_of`` and the newest record not dated after it (NULL when none)."""
    return (records.where(F.col(col) <= F.lit(as_of)).agg(F.max(col).alias("latest_entry"))
            .withColumn("days_since", F.datediff(F.lit(as_of), F.col("latest_entry"))))


def freshness(records: DataFrame, as_of: _dt.date, col: str = "session_date", warn_days: int = 7,
              info_days: int = 3, none_days: int = 999) -> DataFrame:
    """AGG34: days since the last session; > warn_days warning, > info_days info, else ok; 999 if none."""
    g = records.agg(F.max(col).alias("last_session"))
    days = F.coalesce(F.datediff(F.lit(as_of), F.col("last_session")), F.lit(none_days))
    return g.select("last_session", days.alias("days_since_last"),
                    F.when(days > warn_days, "warning").when(days > info_days, "info").otherwise("ok").alias("level"))


# --------------------------------------------------------------------------- rule scoring
# The five rules of the strength scorer and the label per score.
RULES = [
    ("length", None),          # at least 8 characters
    ("uppercase", "[A-Z]"),
    ("lowercase", "[a-z]"),
    ("digit", "[0-9]"),
    ("special", '[!@#$%^&*(),.?":{}|<>]'),
]
MIN_LENGTH = 8
LABELS = {0: "Very Weak", 1: "Very Weak", 2: "Weak", 3: "Medium", 4: "Strong", 5: "Very Strong"}
VALID_FROM = 4


def rule_score(df: DataFrame, col: str, min_length: int = MIN_LENGTH, valid_from: int = VALID_FROM) -> DataFrame:
    """RUL1: score a text column against five rules (length, upper, lower, digit, special).

    Adds ``rule_score`` (0-5), ``rule_label``, ``rule_valid`` (score >= 4) and the
    list of unmet rules.  All rules are JVM regex / length checks.
    """
    c = F.coalesce(F.col(col).cast("string"), F.lit(""))
    checks = [(name, (F.length(c) >= min_length) if pat is None else c.rlike(pat)) for name, pat in RULES]
    score = sum((chk.cast("int") for _, chk in checks[1:]), checks[0][1].cast("int"))
    label = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])[score]
    unmet = F.filter(F.array(*[F.when(~chk, F.lit(name)) for name, chk in checks]), lambda x: x.isNotNull())
    return df.withColumns({"rule_score": score, "rule_label": label, "rule_valid": score >= valid_from,
                           "rule_unmet": unmet})
