"""Declared schemas of the care tables (the reference's fixed DDL as StructTypes).

PK / UNIQUE constraints are not storage features here: they become data-quality
checks (``operators.quality``) and keyed upserts (``operators.updates``).
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, D, TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.DateType(), T.TimestampNTZType()
SCORE, COST, BUDGET = T.DecimalType(8, 2), T.DecimalType(10, 2), T.DecimalType(12, 2)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


USERS = _schema(("id", S), ("username", S), ("role", S), ("full_name", S), ("department", S),
                ("last_login", TS), ("password_expires", TS), ("login_attempts", I),
                ("account_locked", B), ("active", B), ("created_at", TS))
FACILITIES = _schema(("id", S), ("name", S), ("currency", S), ("timezone", S), ("fiscal_year_start", S),
                     ("capacity", I))
INTERVENTIONS = _schema(("id", S), ("name", S), ("category", S), ("description", S),
                        ("cost_per_session", COST), ("duration_minutes", I), ("evidence_level", S),
                        ("active", B), ("created_at", TS))
OUTCOME_METRICS = _schema(("id", S), ("name", S), ("category", S), ("description", S),
                          ("scale_min", SCORE), ("scale_max", SCORE), ("higher_is_better", B),
                          ("clinical_significance_threshold", SCORE), ("unit_of_measure", S),
                          ("active", B), ("created_at", TS))
INDIVIDUALS = _schema(("id", S), ("anonymous_id", S), ("age_group", S), ("gender", S),
                      ("disability_category", S), ("disability_severity", S), ("support_level", S),
                      ("funding_source", S), ("admission_date", D), ("active", B), ("created_at", TS))
OUTCOME_RECORDS = _schema(("id", S), ("individual_id", S), ("intervention_id", S), ("outcome_metric_id", S),
                          ("session_id", S), ("score", SCORE), ("baseline_score", SCORE),
                          ("target_score", SCORE), ("session_date", D), ("session_duration", I),
                          ("attendance_status", S), ("staff_id", S), ("notes", S), ("quality_rating", I),
                          ("recorded_by", S), ("created_at", TS))
COST_RECORDS = _schema(("id", S), ("intervention_id", S), ("individual_id", S), ("session_id", S),
                       ("direct_cost", COST), ("indirect_cost", COST), ("overhead_cost", COST),
                       ("staff_cost", COST), ("material_cost", COST), ("equipment_depreciation", COST),
                       ("cost_date", D), ("created_at", TS))
TREATMENT_GOALS = _schema(("id", S), ("individual_id", S), ("outcome_metric_id", S), ("goal_type", S),
                          ("description", S), ("baseline_value", SCORE), ("target_value", SCORE),
                          ("target_date", D), ("priority_level", I), ("status", S), ("created_by", S),
                          ("created_at", TS))
AUDIT_LOG = _schema(("id", S), ("table_name", S), ("record_id", S), ("action", S), ("old_values", S),
                    ("new_values", S), ("changed_by", S), ("change_reason", S), ("timestamp", TS))
SYSTEM_SETTINGS = _schema(("id", S), ("category", S), ("setting_key", S), ("setting_value", S),
                          ("description", S), ("updated_by", S), ("updated_at", TS))
ALERTS = _schema(("id", S), ("alert_type", S), ("severity", S), ("title", S), ("message", S),
                 ("target_user", S), ("target_role", S), ("is_read", B), ("created_at", TS),
                 ("expires_at", TS))
ASSESSMENT_SCHEDULES = _schema(("id", S), ("individual_id", S), ("outcome_metric_id", S), ("frequency", S),
                               ("start_date", D), ("next_due_date", D), ("active", B), ("created_by", S),
                               ("created_at", TS))
CLINICAL_PROTOCOLS = _schema(("id", S), ("name", S), ("category", S), ("content", S), ("version", S),
                             ("active", B), ("created_at", TS))
BUDGETS = _schema(("id", S), ("fiscal_year", I), ("total_budget", BUDGET), ("notes", S),
                  ("created_at", TS), ("updated_at", TS))

CARE_SCHEMAS: dict[str, T.StructType] = {
    "users": USERS, "facilities": FACILITIES, "interventions": INTERVENTIONS,
    "outcome_metrics": OUTCOME_METRICS, "individuals": INDIVIDUALS, "outcome_records": OUTCOME_RECORDS,
    "cost_records": COST_RECORDS, "treatment_goals": TREATMENT_GOALS, "audit_log": AUDIT_LOG,
    "system_settings": SYSTEM_SETTINGS, "alerts": ALERTS, "assessment_schedules": ASSESSMENT_SCHEDULES,
    "clinical_protocols": CLINICAL_PROTOCOLS, "budgets": BUDGETS,
}

# CSV contracts (all cells read as strings, then try_cast; see sources.csv).
OUTCOMES_CSV_REQUIRED = ["individual_anonymous_id", "intervention_name", "metric_name", "score", "session_date"]
OUTCOMES_CSV_OPTIONAL = ["session_duration", "attendance_status", "quality_rating", "notes"]
INDIVIDUALS_CSV = ["anonymous_id", "age_group", "gender", "disability_category", "admission_date"]
INTERVENTIONS_CSV = ["name", "category", "cost_per_session", "duration_minutes"]
ASSESSMENT_CSV = ["individual_anonymous_id", "assessment_date", "metric_name", "score"]
