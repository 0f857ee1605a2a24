"""UPD1-UPD5, SNK2-SNK5, SNK7: keyed upserts, batch updates, archive, deletes and appends.

Plain parquet tables have no MERGE, so each write operator returns the new
table as a DataFrame (a join rewrite); writing it to a fresh path and swapping
is the caller's business.  For tables that are stored by a partition column the
``*_stored`` forms do the whole update: they read and replace only the partitions
that hold an updated key.  All joins are equi joins on the key.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caremart.plans.materialize import write_stage
from caremart.sources.fs import delete


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str],
           set_cols: Sequence[str] | None = None) -> DataFrame:
    """UPD1/UPD2: insert new keys, overwrite ``set_cols`` of existing keys, keep their other columns.

    New keys take every column the update carries.  ``updates`` rows must be
    unique per key (dedupe first with ``dedupe_keep_first``).  Idempotent.

    Existing rows are a left join, for which a small update is broadcast and the
    target is not shuffled; new rows are an anti join against the target's keys.
    """
    keys = list(keys)
    set_cols = list(set_cols) if set_cols is not None else [c for c in updates.columns if c not in keys]
    u = (updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in set_cols])
         .withColumn("_u_hit", F.lit(True)))
    old = target.join(u, keys, "left").select(*[
        F.when(F.col("_u_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)
        if c in set_cols and c not in keys else F.col(c) for c in target.columns])
    new = updates.join(target.select(*keys), keys, "left_anti").select(*[
        F.col(c) if c in updates.columns else F.lit(None).cast(t).alias(c) for c, t in target.dtypes])
    return old.unionByName(new)


def write_by(df: DataFrame, path: str, part: str) -> None:
    """Write a stored table in one folder for each value of ``part`` (a month, say), with one task for each."""
    df.repartition(part).write.mode("overwrite").partitionBy(part).parquet(path)


def rewrite_parts(spark: SparkSession, path: str, part: str, parts: Sequence, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replace some parts of a table stored by ``part`` by what ``change`` makes of their rows; no other file is touched.

    Only these parts are read (partition pruning).  The new rows are written aside
    first, so the table is never read and replaced at once, and a failed replacement
    can be repeated from what was written.  A part left without rows is deleted.
    """
    parts = sorted(parts)
    if not parts:
        return
    old = spark.read.parquet(path).where(F.col(part).isin(parts))
    new = write_stage(change(old), "rewritten-parts")
    new.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    left = {r[part] for r in new.select(part).distinct().collect()}
    for p in set(parts) - left:
        delete(spark, f"{path}/{part}={p}")


def parts_of_keys(spark: SparkSession, path: str, part: str, keys_df: DataFrame, keys: Sequence[str]) -> list:
    """The parts that hold one of the keys, from a scan of the key columns alone; one value for each part."""
    held = spark.read.parquet(path).select(*keys, part).join(keys_df.select(*keys), list(keys), "left_semi")
    return [r[part] for r in held.select(part).distinct().collect()]


def upsert_stored(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], part: str,
                  set_cols: Sequence[str] | None = None) -> None:
    """UPD1/UPD2 in place: ``upsert`` on the parts that hold an updated key or get a new one.

    ``updates`` carry ``part``; an existing row stays in its own part unless ``set_cols`` name it.
    """
    parts = {*parts_of_keys(spark, path, part, updates, keys), *[r[part] for r in updates.select(part).distinct().collect()]}
    rewrite_parts(spark, path, part, list(parts), lambda old: upsert(old, updates, keys, set_cols))


def batch_update_stored(spark: SparkSession, path: str, updates: DataFrame, key: str, cols: Sequence[str], part: str) -> None:
    """UPD4 in place: ``batch_update`` on the parts that hold an updated key."""
    rewrite_parts(spark, path, part, parts_of_keys(spark, path, part, updates, [key]),
                  lambda old: batch_update(old, updates, key, cols))


def delete_stored(spark: SparkSession, path: str, keys_df: DataFrame, keys: Sequence[str], part: str) -> None:
    """UPD5 in place: ``delete_by_key`` on the parts that hold such a key."""
    rewrite_parts(spark, path, part, parts_of_keys(spark, path, part, keys_df, keys),
                  lambda old: delete_by_key(old, keys_df, keys))


def archive_stored(spark: SparkSession, path: str, part: str, predicate, active_col: str = "active") -> None:
    """UPD3 in place: ``archive`` on the parts with a row that the predicate holds for and that is not archived yet."""
    due = spark.read.parquet(path).where(predicate & F.coalesce(F.col(active_col), F.lit(True)))
    rewrite_parts(spark, path, part, [r[part] for r in due.select(part).distinct().collect()],
                  lambda old: archive(old, predicate, active_col))


def batch_update(target: DataFrame, updates: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """UPD4/DQ6: overwrite the given columns by key where the update has a non-NULL value."""
    u = updates.select(F.col(key), *[F.col(c).alias(f"_u_{c}") for c in cols])
    j = target.join(u, key, "left")
    return j.select(*[F.coalesce(F.col(f"_u_{c}").cast(dict(target.dtypes)[c]), F.col(c)).alias(c)
                      if c in cols else F.col(c) for c in target.columns])


def archive(df: DataFrame, predicate, active_col: str = "active") -> DataFrame:
    """UPD3: soft delete: ``active = FALSE`` where the predicate holds (adds the column if missing)."""
    cur = F.col(active_col) if active_col in df.columns else F.lit(True)
    return df.withColumn(active_col, F.when(predicate, F.lit(False)).otherwise(cur))


def archive_older_than(df: DataFrame, as_of: _dt.date, days: int = 2555, date_col: str = "session_date",
                       active_col: str = "active") -> DataFrame:
    """UPD3: archive records older than ``days`` (seven years by default) before ``as_of``."""
    return archive(df, F.col(date_col) < F.date_sub(F.lit(as_of), days), active_col)


def delete_by_key(target: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """UPD5: remove rows whose key appears in ``keys_df`` (left anti join)."""
    return target.join(keys_df.select(*keys), list(keys), "left_anti")


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Select ``df`` into ``schema``: missing columns become the default (DDL DEFAULT) or NULL."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        else:
            c = F.lit(defaults.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def append_rows(target: DataFrame, new: DataFrame, defaults: Mapping[str, object] | None = None,
                id_col: str | None = "id", id_from: Sequence[str] | None = None) -> DataFrame:
    """SNK2/SNK7/SET3: the table with ``new`` appended in the target's schema.

    Fresh ids: ``uuid()`` by default, or a deterministic hash of ``id_from``.
    """
    n = new
    if id_col and id_col not in n.columns:
        n = n.withColumn(id_col, F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in id_from]), 256)
                         if id_from else F.expr("uuid()"))
    return target.unionByName(conform(n, target.schema, defaults))


# Fixed values of the emergency quick entry.
EMERGENCY_PREFIX = "EMERGENCY ENTRY: "
EMERGENCY_RATING = 3


def quick_entries(entries: DataFrame, metrics: DataFrame) -> DataFrame:
    """SNK3: emergency entries scored on the oldest active metric, rating 3, notes prefixed."""
    m = metrics.where(F.col("active")).agg(F.min_by("id", F.struct("created_at", "id")).alias("outcome_metric_id"))
    return (entries.crossJoin(F.broadcast(m))  # one-row side
            .withColumns({"quality_rating": F.lit(EMERGENCY_RATING),
                          "notes": F.concat(F.lit(EMERGENCY_PREFIX), F.coalesce(F.col("notes"), F.lit(""))),
                          "attendance_status": F.lit("attended")}))


# Fixed values of the follow-up alert an emergency entry raises.
EMERGENCY_ALERT = ("data_quality", "warning", "Emergency Entry Requires Review", "Administrator")


def emergency_alerts(entries: DataFrame, who: str = "anonymous_id", created_col: str = "session_date") -> DataFrame:
    """SNK3/SNK5: one follow-up alert per emergency entry, for the administrators."""
    kind, severity, title, role = EMERGENCY_ALERT
    msg = F.concat(F.lit("Emergency data entry for "), F.col(who).cast("string"),
                   F.lit(" needs complete documentation"))
    return alert_rows(entries, kind, severity, title, msg, created_col, target_role=role)


def audit_rows(changes: DataFrame, table: str, action: str, key: str, old_cols: Sequence[str] | None,
               new_cols: Sequence[str] | None, changed_by: str | None = None, reason: str | None = None,
               at=None) -> DataFrame:
    """SNK4: audit-log rows with JSON old/new values (``to_json`` of a struct; NULL when not given).

    The id hashes table, action, key, time and both values, so several changes of
    one record have different ids, and a retried task gives the same one.
    """
    def js(cols):
        # keep NULL fields, as json.dumps does
        return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}) if cols else F.lit(None).cast("string")
    ts = F.lit(at).cast("timestamp_ntz") if at is not None else F.localtimestamp()
    payload = [F.coalesce(js(c), F.lit("")) for c in (old_cols, new_cols)]
    return changes.select(
        F.sha2(F.concat_ws("|", F.lit(table), F.lit(action), F.col(key).cast("string"),
                           F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), *payload), 256).alias("id"),
        F.lit(table).alias("table_name"), F.col(key).cast("string").alias("record_id"), F.lit(action).alias("action"),
        js(old_cols).alias("old_values"), js(new_cols).alias("new_values"),
        F.lit(changed_by).cast("string").alias("changed_by"), F.lit(reason).cast("string").alias("change_reason"),
        ts.alias("timestamp"))


def alert_rows(df: DataFrame, alert_type: str, severity: str, title: str, message, created_col: str,
               target_user=None, target_role: str | None = None, ttl_days: int = 30) -> DataFrame:
    """SNK5: alert rows expiring ``ttl_days`` after creation."""
    msg = message if not isinstance(message, str) else F.lit(message)
    user = target_user if target_user is None or not isinstance(target_user, str) else F.col(target_user)
    return df.select(
        F.lit(alert_type).alias("alert_type"), F.lit(severity).alias("severity"), F.lit(title).alias("title"),
        msg.alias("message"),
        (user.cast("string") if user is not None else F.lit(None).cast("string")).alias("target_user"),
        F.lit(target_role).cast("string").alias("target_role"), F.lit(False).alias("is_read"),
        F.col(created_col).cast("timestamp_ntz").alias("created_at"),
        (F.col(created_col).cast("timestamp_ntz") + F.expr(f"INTERVAL {ttl_days} DAYS")).alias("expires_at"))
