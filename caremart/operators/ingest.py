"""ING1-ING9, JN8-JN11, SET1: validation and import of bulk outcome batches.

A batch is a DataFrame of strings (see ``sources.csv``) with an ``row_num``
column giving file order.  Validation issues are rows, not exceptions; the
import resolves names to ids with joins (no per-row lookups) and applies
``skip_duplicates`` against stored records and earlier rows of the same batch.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caremart.operators.ranking import top_n_per_key
from caremart.operators.updates import audit_rows
from caremart.plans.materialize import write_stage
from caremart.schemas import OUTCOMES_CSV_REQUIRED

# Import defaults for absent optional columns.
IMPORT_DEFAULTS = {"session_duration": 45, "attendance_status": "attended", "quality_rating": 4, "notes": ""}
BATCH_DUP_KEYS = ("individual_anonymous_id", "intervention_name", "session_date")


def missing_columns(batch: DataFrame, required: Sequence[str] = OUTCOMES_CSV_REQUIRED) -> list[str]:
    """ING1: required columns absent from the batch schema (a schema check on the driver)."""
    return [c for c in required if c not in batch.columns]


def typed(batch: DataFrame) -> DataFrame:
    """ING2 helper: score as double and session_date as date; bad text becomes NULL."""
    return batch.withColumns({
        "score_value": F.col("score").try_cast("double"),
        "session_day": F.coalesce(F.try_to_date(F.col("session_date"), "yyyy-MM-dd"),
                                  F.try_to_timestamp(F.col("session_date")).cast("date"))})


def conversion_errors(batch: DataFrame) -> DataFrame:
    """ING2: rows whose score or date does not convert (row-level; the reference fails the whole file).

    A blank is not a conversion error; blank scores are range errors (ING4).
    """
    t = typed(batch)
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    bad_score = ~blank("score") & F.col("score_value").isNull()
    bad_date = ~blank("session_date") & F.col("session_day").isNull()
    return (t.where(bad_score | bad_date)
            .select("row_num", F.when(bad_score, F.col("score")).alias("bad_score"),
                    F.when(bad_date, F.col("session_date")).alias("bad_date")))


def unknown_refs(batch: DataFrame, dim: DataFrame, batch_col: str, dim_col: str,
                 active_only: bool = True) -> DataFrame:
    """JN8/SET1/ING3: distinct batch values missing from the (active) dimension, as a left anti join."""
    d = dim.where(F.col("active")) if active_only and "active" in dim.columns else dim
    vals = batch.select(F.col(batch_col).alias("value")).where(F.col("value").isNotNull()).distinct()
    return vals.join(d.select(F.col(dim_col).cast("string").alias("value")), "value", "left_anti")


def unknown_reference_report(batch: DataFrame, individuals: DataFrame, interventions: DataFrame,
                             metrics: DataFrame, first_k: int = 5) -> DataFrame:
    """ING3/SRT2: per reference kind the number of unknown values and the first ``first_k`` (sorted)."""
    # one pass over the batch: distinct (kind, value), then one anti join with the known names of all kinds
    refs = {"individual": ("individual_anonymous_id", individuals, "anonymous_id"),
            "intervention": ("intervention_name", interventions, "name"), "metric": ("metric_name", metrics, "name")}
    values = batch.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))
                                              for k, (c, _, _) in refs.items()])).alias("r")).select("r.*")
    known = None
    for k, (_, dim, name) in refs.items():
        d = dim.where(F.col("active")) if "active" in dim.columns else dim
        d = d.select(F.lit(k).alias("kind"), F.col(name).cast("string").alias("value"))
        known = d if known is None else known.unionByName(d)
    u = values.where(F.col("value").isNotNull()).distinct().join(known, ["kind", "value"], "left_anti")
    u = write_stage(u, "unknown-references")
    counts = u.groupBy("kind").agg(F.count(F.lit(1)).alias("unknown_count"))
    # only the first k values per kind are gathered (salted top-k, never all unknown values in one task)
    first = (top_n_per_key(u, ["kind"], [F.asc("value")], first_k).groupBy("kind")
             .agg(F.array_join(F.sort_array(F.collect_list("value")), ", ").alias("first_values")))
    return counts.join(first, "kind")


def range_violations(batch: DataFrame, metrics: DataFrame, active_only: bool = True) -> DataFrame:
    """JN11/ING4: one row per batch row whose score is blank or outside its (active) metric's scale."""
    m = metrics.where(F.col("active")) if active_only and "active" in metrics.columns else metrics
    m = m.select(F.col("name").alias("metric_name"), F.col("scale_min").cast("double").alias("scale_min"),
                 F.col("scale_max").cast("double").alias("scale_max"))
    t = typed(batch).join(m, "metric_name")
    blank = F.coalesce(F.trim(F.col("score")) == "", F.lit(True))
    return (t.where(blank | ~F.col("score_value").between(F.col("scale_min"), F.col("scale_max")))
            .select("row_num", "metric_name", F.col("score_value").alias("score"), "scale_min", "scale_max"))


def batch_warnings(batch: DataFrame, as_of: _dt.date, keys: Sequence[str] = BATCH_DUP_KEYS) -> DataFrame:
    """ING5/ING6: future-dated rows and in-file duplicates (second and later rows of a key)."""
    t = typed(batch)
    fut = t.agg(F.count_if(F.col("session_day") > F.lit(as_of)).alias("future_dates"))
    dup = (batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
           .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates")))
    return fut.crossJoin(dup)  # one row x one row


def resolve_ids(batch: DataFrame, individuals: DataFrame, interventions: DataFrame, metrics: DataFrame,
                active_only: bool = False) -> DataFrame:
    """JN9: names -> ids with three equi joins; rows with an unresolved name are dropped (as the reference).

    Rows whose score or date does not convert are dropped too (the reference's
    insert would fail the whole batch on them; they are reported by ING2).
    """
    def dim(df, name_col, out):
        d = df.where(F.col("active")) if active_only and "active" in df.columns else df
        # a name that several rows share resolves to its smallest id
        return d.groupBy(F.col(name_col).cast("string").alias(f"_{out}_name")).agg(F.min("id").alias(out))
    p, i, m = dim(individuals, "anonymous_id", "individual_id"), dim(interventions, "name", "intervention_id"), \
        dim(metrics, "name", "outcome_metric_id")
    return (typed(batch).where(F.col("score_value").isNotNull() & F.col("session_day").isNotNull())
            .join(p, F.col("individual_anonymous_id") == F.col("_individual_id_name"))
            .join(i, F.col("intervention_name") == F.col("_intervention_id_name"))
            .join(m, F.col("metric_name") == F.col("_outcome_metric_id_name"))
            .drop("_individual_id_name", "_intervention_id_name", "_outcome_metric_id_name"))


# Why a row of a batch cannot be imported, in the order in which they are listed.
REJECT_REASONS = ("score does not convert", "date does not convert", "score is missing", "date is missing",
                  "unknown individual", "unknown intervention", "unknown metric", "score is out of range")


def name_ids(individuals: DataFrame, interventions: DataFrame, metrics: DataFrame, check_scale: bool = True,
             active_only: bool = True) -> dict[str, DataFrame]:
    """For each name column of a batch its ``_name`` with the id it stands for: the smallest of those that share it.

    With ``check_scale`` the metrics' come with that row's scale.
    """
    def dim(df, name_col, out, *more):
        d = df.where(F.col("active")) if active_only and "active" in df.columns else df
        return d.groupBy(F.col(name_col).cast("string").alias("_name")).agg(
            F.min("id").alias(out), *[F.min_by(F.col(c).cast("double"), "id").alias(f"_{c}") for c in more])
    return {"individual_anonymous_id": dim(individuals, "anonymous_id", "individual_id"),
            "intervention_name": dim(interventions, "name", "intervention_id"),
            "metric_name": dim(metrics, "name", "outcome_metric_id", *(("scale_min", "scale_max") if check_scale else ()))}


def judged_rows(batch: DataFrame, individuals: DataFrame, interventions: DataFrame, metrics: DataFrame,
                check_scale: bool = True, active_only: bool = True) -> DataFrame:
    """ING2-ING4 for each row: the ``typed`` batch with its ids and ``reasons``, the list of what is wrong with it.

    Rows without reasons can be imported.  A name that several (active) rows share
    resolves to its smallest id, and to that row's scale.
    """
    return judged_by(batch, name_ids(individuals, interventions, metrics, check_scale, active_only), check_scale)


def judged_by(batch: DataFrame, ids: Mapping[str, DataFrame], check_scale: bool = True) -> DataFrame:
    """``judged_rows`` by the names' ids (``name_ids``)."""
    j = typed(batch)
    for name, d in ids.items():
        j = j.join(d, F.col(name) == F.col("_name"), "left").drop("_name")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    score, day = F.col("score_value"), F.col("session_day")
    scale = score.between(F.col("_scale_min"), F.col("_scale_max")) if check_scale else F.lit(True)
    wrong = (~blank("score") & score.isNull(), ~blank("session_date") & day.isNull(), blank("score"),
             blank("session_date"), F.col("individual_id").isNull(), F.col("intervention_id").isNull(),
             F.col("outcome_metric_id").isNull(), score.isNotNull() & ~scale)
    reasons = F.array_compact(F.array(*[F.when(w, F.lit(r)) for w, r in zip(wrong, REJECT_REASONS)]))
    return j.withColumn("reasons", reasons).drop("_scale_min", "_scale_max")


def import_outcomes(batch: DataFrame, individuals: DataFrame, interventions: DataFrame, metrics: DataFrame,
                    existing: DataFrame | None = None, skip_duplicates: bool = True,
                    recorded_by: str | None = None, batch_id: str | None = None) -> DataFrame:
    """ING7/ING8/JN10: the outcome rows an import inserts.

    With ``skip_duplicates`` a row is skipped when (individual, intervention,
    date) is already stored or an earlier row of the batch (by ``row_num``)
    with that key is imported.  ``row_num`` may be a number or a sortable row key
    (``sources.csv``).  Ids hash ``batch_id`` and the row, so rows of different
    imports never share an id or a session; without a ``batch_id`` each call takes a
    fresh one.
    """
    return new_rows(resolve_ids(batch, individuals, interventions, metrics), existing, skip_duplicates, recorded_by,
                    batch_id)


def new_rows(resolved: DataFrame, existing: DataFrame | None = None, skip_duplicates: bool = True,
             recorded_by: str | None = None, batch_id: str | None = None) -> DataFrame:
    """ING7/ING8: the outcome rows that resolved batch rows insert (see ``import_outcomes``)."""
    batch_id = batch_id or uuid.uuid4().hex
    r = resolved
    keys = ["individual_id", "intervention_id", "session_day"]
    if skip_duplicates:
        if existing is not None:
            stored = existing.select("individual_id", "intervention_id", F.col("session_date").alias("session_day"))
            r = r.join(stored, keys, "left_anti")
        # first row of each key in file order, limited to one per key and task before the shuffle
        w = Window.partitionBy(*keys).orderBy("row_num")
        r = r.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    def opt(c, default, dtype):
        v = F.col(c) if c in resolved.columns else F.lit(None)
        return F.coalesce(v.cast(dtype), F.lit(default).cast(dtype))
    def fresh(kind):
        return F.sha2(F.concat_ws("|", F.lit(kind), F.lit(batch_id), F.col("row_num").cast("string")), 256)
    return r.select(
        fresh("import").alias("id"), "row_num", "individual_id", "intervention_id", "outcome_metric_id",
        fresh("session").alias("session_id"),
        F.col("score_value").alias("score"), F.col("session_day").alias("session_date"),
        opt("session_duration", IMPORT_DEFAULTS["session_duration"], "int").alias("session_duration"),
        opt("attendance_status", IMPORT_DEFAULTS["attendance_status"], "string").alias("attendance_status"),
        opt("quality_rating", IMPORT_DEFAULTS["quality_rating"], "int").alias("quality_rating"),
        opt("notes", IMPORT_DEFAULTS["notes"], "string").alias("notes"),
        F.lit(recorded_by).cast("string").alias("recorded_by"))


def import_counts(batch: DataFrame, imported: DataFrame, resolved: DataFrame) -> DataFrame:
    """ING8: imported, skipped and unresolved counts (imported + skipped + unresolved = batch rows)."""
    b = batch.agg(F.count(F.lit(1)).alias("batch_rows"))
    i = imported.agg(F.count(F.lit(1)).alias("imported"))
    r = resolved.agg(F.count(F.lit(1)).alias("resolved"))
    return b.crossJoin(i).crossJoin(r).select(
        "batch_rows", "imported", (F.col("resolved") - F.col("imported")).alias("skipped"),
        (F.col("batch_rows") - F.col("resolved")).alias("unresolved"))


# --------------------------------------------------------------------------- session entry
def prepare_sessions(entries: DataFrame, interventions: DataFrame, history: DataFrame, as_of: _dt.date,
                     min_notes: int = 10, default_cost: float = 50.0) -> DataFrame:
    """ING9: validate session entries and expand them to one outcome row per metric.

    ``entries`` holds one row per session with ``scores: map<metric_id, score>``.
    Errors (notes shorter than ``min_notes`` trimmed characters, future date, no
    metric) are collected in ``errors``; valid sessions explode to metric rows
    with the individual's first score for the metric as baseline (else the new
    score) and the intervention's price (else ``default_cost``) as direct cost.
    """
    errs = F.filter(F.array(
        F.when(F.length(F.trim(F.coalesce(F.col("notes"), F.lit("")))) < min_notes,
               F.lit(f"notes shorter than {min_notes} characters")),
        F.when(F.col("session_date") > F.lit(as_of), F.lit("session date in the future")),
        F.when(F.coalesce(F.size(F.col("scores")), F.lit(0)) < 1, F.lit("no metric scored"))),
        lambda x: x.isNotNull())
    e = entries.withColumn("errors", errs)
    rows = (e.where(F.size("errors") == 0)
            .select("*", F.explode("scores").alias("outcome_metric_id", "score")).drop("scores"))
    base = history.groupBy("individual_id", "outcome_metric_id").agg(
        F.min_by("score", F.struct("session_date", "created_at", "id")).alias("_first"))
    price = interventions.select(F.col("id").alias("intervention_id"),
                                 F.col("cost_per_session").cast("double").alias("_price"))
    out = (rows.join(base, ["individual_id", "outcome_metric_id"], "left").join(price, "intervention_id", "left")
           .withColumns({"baseline_score": F.coalesce(F.col("_first").cast("double"), F.col("score").cast("double")),
                         "direct_cost": F.coalesce(F.col("_price"), F.lit(default_cost))})
           .drop("_first", "_price"))
    return out


def session_cost_rows(prepared: DataFrame, session_col: str = "session_key") -> DataFrame:
    """SNK2: the one cost row a session entry writes (direct cost only, as the reference)."""
    return prepared.groupBy(session_col, "individual_id", "intervention_id", "session_date").agg(
        F.max("direct_cost").alias("direct_cost"))


def stored_session(prepared: DataFrame, recorded_by: str, at: _dt.datetime, session_col: str = "session_key",
                   rating: int = IMPORT_DEFAULTS["quality_rating"],
                   duration: int = IMPORT_DEFAULTS["session_duration"]) -> dict[str, DataFrame]:
    """SNK2: the rows that storing session entries appends: ``outcomes``, ``costs`` and ``audit``.

    One outcome row per metric; the rows of a session share its session id.  Notes
    are trimmed; columns the entry lacks take the given defaults.  Ids hash the
    session key (and metric), so storing an entry again gives the same ids.
    """
    def opt(c, default, dtype):
        v = F.col(c) if c in prepared.columns else F.lit(None)
        return F.coalesce(v.cast(dtype), F.lit(default).cast(dtype)).alias(c)
    def fresh(kind, *cols):
        return F.sha2(F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in cols]), 256)
    sid = fresh("session", session_col)
    outcomes = prepared.select(
        fresh("outcome", session_col, "outcome_metric_id").alias("id"), sid.alias("session_id"), "individual_id",
        "intervention_id", "outcome_metric_id", F.col("score").cast("double").alias("score"), "baseline_score",
        "session_date", opt("session_duration", duration, "int"), opt("attendance_status", "attended", "string"),
        opt("quality_rating", rating, "int"), F.trim("notes").alias("notes"), F.lit(recorded_by).alias("recorded_by"),
        F.lit(at).cast("timestamp_ntz").alias("created_at"))
    costs = session_cost_rows(prepared, session_col).select(
        fresh("cost", session_col).alias("id"), sid.alias("session_id"), "individual_id", "intervention_id",
        "direct_cost", F.col("session_date").alias("cost_date"))
    sessions = prepared.groupBy(session_col, "individual_id", "intervention_id", "session_date").agg(
        F.count(F.lit(1)).alias("metrics")).withColumn("session_id", sid)
    audit = audit_rows(sessions, "outcome_records", "INSERT", "session_id", None,
                       ["individual_id", "intervention_id", "metrics"], recorded_by, "session entry", at)
    return {"outcomes": outcomes, "costs": costs, "audit": audit}


def rejected_sessions(entries: DataFrame, as_of: _dt.date, min_notes: int = 10) -> DataFrame:
    """ING9: the entries that fail validation, with their error list."""
    errs = F.filter(F.array(
        F.when(F.length(F.trim(F.coalesce(F.col("notes"), F.lit("")))) < min_notes,
               F.lit(f"notes shorter than {min_notes} characters")),
        F.when(F.col("session_date") > F.lit(as_of), F.lit("session date in the future")),
        F.when(F.coalesce(F.size(F.col("scores")), F.lit(0)) < 1, F.lit("no metric scored"))),
        lambda x: x.isNotNull())
    return entries.withColumn("errors", errs).where(F.size("errors") > 0)
