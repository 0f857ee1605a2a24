"""DuckDB oracle SQL: the care views over the driver tables, and the mart in plain SQL.

Used only to cross-check the Spark operators (the driver runs these strings in
DuckDB next to the Spark queries).  The view definitions mirror
``caremart.sources.adapter`` value for value.
"""

from __future__ import annotations

CARE_VIEWS = {
    "c_interventions": """SELECT p_type AS id, p_type AS name, 'Category ' || (count(*) % 3) AS category,
   CAST(20 + sum(p_size) % 80 AS DOUBLE) AS cost_per_session, CAST(30 + 15 * (sum(p_size) % 7) AS INTEGER)
   AS duration_minutes, TRUE AS active, 'Moderate' AS evidence_level FROM part GROUP BY p_type""",
    "c_metrics": """SELECT CAST(id AS INTEGER) AS id, name, category, CAST(scale_min AS DOUBLE) AS scale_min,
   CAST(scale_max AS DOUBLE) AS scale_max, higher_is_better, TRUE AS active,
   CAST(id * 0.5 AS DOUBLE) AS clinical_significance_threshold, 'unit ' || id AS unit_of_measure,
   make_timestamp(2020, 1, CAST(id AS BIGINT), 0, 0, 0) AS created_at
 FROM (VALUES (1,'M1','Behavioral',0.0,50.0,true),(2,'M2','Behavioral',0.0,50.0,false),
  (3,'M3',NULL,1.0,45.0,true),(4,'M4','Social',5.0,50.0,false),(5,'M5','Cognitive',0.0,100.0,true),
  (6,'M6','Social',10.0,10.0,true),(7,'M7','Cognitive',NULL,NULL,true))
  t(id, name, category, scale_min, scale_max, higher_is_better) WHERE id IN (SELECT l_linenumber FROM lineitem)""",
    "c_individuals": """SELECT c_custkey AS id, c_name AS anonymous_id,
   CASE c_custkey % 4 WHEN 0 THEN '18-30' WHEN 1 THEN '31-45' WHEN 2 THEN '46-60' ELSE '60+' END AS age_group,
   NULLIF(c_mktsegment, 'FURNITURE') AS disability_category, r_name AS support_level,
   DATE '2000-01-01' + CAST(c_custkey % 365 AS INTEGER) AS admission_date,
   CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'F' ELSE 'M' END AS gender,
   CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Mild' ELSE 'Severe' END AS disability_severity,
   c_mktsegment AS funding_source, TRUE AS active
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "c_staff": """SELECT s_suppkey AS id, s_name AS full_name,
   CASE WHEN s_suppkey % 10 = 0 THEN 'Supervisor' ELSE 'Staff' END AS role FROM supplier""",
    "c_outcomes": """SELECT
   concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_shipdate AS DATE),
             CAST(l_quantity AS BIGINT)) AS id,
   concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_shipdate AS DATE),
             CAST(l_quantity AS BIGINT)) AS session_id,
   o_custkey AS individual_id, p_type AS intervention_id, l_linenumber AS outcome_metric_id,
   CAST(NULLIF(l_quantity, 13.0) AS DOUBLE) AS score, CAST(5.0 * l_linenumber AS DOUBLE) AS baseline_score,
   CAST(NULL AS DOUBLE) AS target_score, CAST(l_shipdate AS DATE) AS session_date,
   NULLIF(CAST(30 + l_partkey % 31 AS INTEGER), 40) AS session_duration,
   CASE l_orderkey % 10 WHEN 0 THEN 'absent' WHEN 1 THEN 'partial' ELSE 'attended' END AS attendance_status,
   CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey END AS staff_id,
   NULLIF(CAST(1 + (l_orderkey + l_partkey) % 5 AS INTEGER), 1) AS quality_rating,
   CASE l_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'ok ' || l_returnflag
        ELSE 'progress noted ' || l_returnflag || l_linestatus END AS notes,
   o_orderdate AS created_at, 'recorder ' || (l_suppkey % 50) AS recorded_by
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "c_costs": """SELECT
   concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_shipdate AS DATE),
             CAST(l_quantity AS BIGINT)) AS session_id,
   p_type AS intervention_id, l_extendedprice / 100 AS direct_cost,
   CASE WHEN l_linenumber = 5 THEN NULL ELSE 0.0 END AS indirect_cost,
   l_extendedprice * l_discount / 100 AS overhead_cost, l_extendedprice * l_tax / 100 AS material_cost,
   CAST(l_shipdate AS DATE) AS cost_date
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 10 <> 0""",
    "c_goals": """SELECT c_custkey * 10 + m.id AS id, c_custkey AS individual_id, m.id AS outcome_metric_id,
   'Improvement' AS goal_type,
   CASE WHEN m.higher_is_better THEN 10.0 ELSE 40.0 END AS baseline_value,
   CASE WHEN m.higher_is_better THEN 40.0 ELSE 10.0 END AS target_value,
   DATE '2001-01-01' + CAST(c_custkey % 180 AS INTEGER) AS target_date, 1 + c_custkey % 3 AS priority_level,
   CASE WHEN c_custkey % 4 = 0 THEN 'closed' ELSE 'active' END AS status
 FROM customer, c_metrics m WHERE m.id <= 5""",
    "c_schedules": """SELECT id, individual_id, outcome_metric_id,
   (['Weekly', 'Bi-Weekly', 'Monthly', 'Quarterly'])[CAST(id % 4 + 1 AS INTEGER)] AS frequency,
   target_date - 60 AS start_date FROM c_goals""",
    "c_import": """SELECT ((l_orderkey * 10000000 + l_partkey) * 10000 + l_suppkey) * 8 + l_linenumber AS row_num,
   CASE WHEN o_custkey % 53 = 0 THEN 'UNKNOWN-' || o_custkey ELSE c_name END AS individual_anonymous_id,
   CASE WHEN l_partkey % 71 = 0 THEN lower(p_type) ELSE p_type END AS intervention_name,
   'M' || CAST(l_linenumber + CASE WHEN l_orderkey % 61 = 0 THEN 10 ELSE 0 END AS VARCHAR) AS metric_name,
   CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS score,
   CASE WHEN l_orderkey % 89 = 0 THEN 'not a date' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS session_date,
   CAST(30 + l_partkey % 31 AS VARCHAR) AS session_duration
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'""",
    "c_import_typed": """SELECT *, TRY_CAST(score AS DOUBLE) AS score_value,
   CAST(try_strptime(session_date, '%Y-%m-%d') AS DATE) AS session_day FROM c_import""",
    "c_entries": """SELECT o_orderkey AS session_key, o_custkey AS individual_id,
   (['STANDARD', 'PROMO', 'SMALL', 'LARGE', 'ECONOMY', 'MEDIUM'])[CAST(o_orderkey % 6 + 1 AS INTEGER)] AS intervention_id,
   CAST(o_orderdate AS DATE) AS session_date, o_orderpriority AS notes,
   (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders""",
    "c_entry_scores": """SELECT l_orderkey AS session_key, l_linenumber AS outcome_metric_id, max(l_quantity) AS score
 FROM lineitem GROUP BY 1, 2""",
    "c_budgets": """SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year, CAST(total_budget AS DOUBLE) AS total_budget
 FROM (VALUES (1995,4e6),(1996,5e6),(1997,5e6),(1998,5e6),(1999,5e6),(2000,5e6),(2001,4e6)) t(fiscal_year, total_budget)""",
    "c_logins": """SELECT event_id, user_id, ts, event_type = 'error' AS failed
 FROM events WHERE event_type IN ('error', 'click', 'signup')""",
}

NUMERIC_IMPUTE = ["cost_per_session", "session_duration", "quality_rating", "direct_cost", "indirect_cost",
                  "overhead_cost", "material_cost", "score", "baseline_score"]
CATEGORICAL_IMPUTE = ["intervention_category", "metric_category", "age_group", "disability_category",
                      "support_level", "staff_name"]
STAR_COLUMNS = [
    ("id", "o.id"), ("session_id", "o.session_id"), ("individual_id", "o.individual_id"),
    ("intervention_id", "o.intervention_id"), ("outcome_metric_id", "o.outcome_metric_id"),
    ("session_date", "o.session_date"), ("attendance_status", "o.attendance_status"), ("staff_id", "o.staff_id"),
    ("notes", "o.notes"), ("created_at", "o.created_at"), ("score", "o.score"),
    ("baseline_score", "o.baseline_score"), ("target_score", "o.target_score"),
    ("session_duration", "CAST(o.session_duration AS DOUBLE)"),
    ("quality_rating", "CAST(o.quality_rating AS DOUBLE)"), ("intervention_name", "i.name"),
    ("intervention_category", "i.category"), ("cost_per_session", "i.cost_per_session"),
    ("planned_duration", "CAST(i.duration_minutes AS DOUBLE)"), ("evidence_level", "i.evidence_level"),
    ("metric_name", "m.name"), ("metric_category", "m.category"), ("scale_min", "m.scale_min"),
    ("scale_max", "m.scale_max"),
    ("higher_is_better", "m.higher_is_better"),
    ("clinical_significance_threshold", "m.clinical_significance_threshold"), ("unit_of_measure", "m.unit_of_measure"),
    ("gender", "p.gender"), ("disability_severity", "p.disability_severity"), ("funding_source", "p.funding_source"),
    ("recorded_by", "o.recorded_by"),
    ("anonymous_id", "p.anonymous_id"), ("age_group", "p.age_group"),
    ("disability_category", "p.disability_category"), ("support_level", "p.support_level"),
    ("staff_name", "u.full_name"), ("direct_cost", "CAST(c.direct_cost AS DOUBLE)"),
    ("indirect_cost", "CAST(c.indirect_cost AS DOUBLE)"), ("overhead_cost", "CAST(c.overhead_cost AS DOUBLE)"),
    ("material_cost", "CAST(c.material_cost AS DOUBLE)"),
]
FILTER_SQL = {"intervention": "i.name", "age_group": "p.age_group", "disability": "p.disability_category",
              "staff": "u.full_name"}


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if hasattr(v, "isoformat"):
        return f"DATE '{v.isoformat()}'"
    return str(v)


def mart_ctes(period=None, filters=None, prefix: str = "mart") -> str:
    """CTEs ending in a view named ``prefix`` equal to ``outcome_mart(period, filters)``."""
    where = ["o.attendance_status = 'attended'"]
    if period:
        if period[0] is not None:
            where.append(f"o.session_date >= {_lit(period[0])}")
        if period[1] is not None:
            where.append(f"o.session_date <= {_lit(period[1])}")
    for k, v in (filters or {}).items():
        if v is None or v == "All":
            continue
        where.append(f"{FILTER_SQL[k]} = {_lit(v)}")
    star_cols = ",\n   ".join(f"{e} AS {n}" for n, e in STAR_COLUMNS)
    meds = ", ".join(f"median({c}) AS md_{c}" for c in NUMERIC_IMPUTE)
    modes = ",\n   ".join(
        f"(SELECT {c} FROM {prefix}_star WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        f" AS mo_{c}" for c in CATEGORICAL_IMPUTE)
    imp_cols = []
    for n, _ in STAR_COLUMNS:
        if n in NUMERIC_IMPUTE:
            imp_cols.append(f"coalesce({n}, md_{n}) AS {n}")
        elif n in CATEGORICAL_IMPUTE:
            imp_cols.append(f"coalesce({n}, mo_{n}, 'Unknown') AS {n}")
        else:
            imp_cols.append(n)
    imp = ",\n   ".join(imp_cols)
    return f"""{prefix}_star AS (
 SELECT {star_cols}
 FROM c_outcomes o JOIN c_interventions i ON o.intervention_id = i.id
  JOIN c_metrics m ON o.outcome_metric_id = m.id
  JOIN c_individuals p ON o.individual_id = p.id
  LEFT JOIN c_staff u ON o.staff_id = u.id
  LEFT JOIN c_costs c ON o.session_id = c.session_id
 WHERE {' AND '.join(where)}
),
{prefix}_med AS (SELECT {meds} FROM {prefix}_star),
{prefix}_mode AS (SELECT {modes}),
{prefix}_imp AS (
 SELECT {imp}
 FROM {prefix}_star, {prefix}_med, {prefix}_mode
),
{prefix}_der AS (
 SELECT *,
   coalesce(direct_cost, 0) + coalesce(indirect_cost, 0) + coalesce(overhead_cost, 0)
     + coalesce(material_cost, 0) AS total_cost,
   CASE WHEN nr IS NULL THEN NULL ELSE greatest(0.0, least(10.0, nr)) END AS norm_raw
 FROM (SELECT *,
   CASE WHEN scale_min IS NULL OR scale_max IS NULL THEN NULL
        WHEN scale_max = scale_min THEN 5.0
        WHEN coalesce(higher_is_better, false) THEN (score - scale_min) / (scale_max - scale_min) * 10
        ELSE (scale_max - score) / (scale_max - scale_min) * 10 END AS nr
   FROM {prefix}_imp) x
),
{prefix}_med2 AS (SELECT median(norm_raw) AS md_norm FROM {prefix}_der),
{prefix} AS (
 SELECT * EXCLUDE (nr, norm_raw, md_norm),
   total_cost - cost_per_session AS cost_variance,
   session_duration - planned_duration AS duration_variance,
   coalesce(norm_raw, md_norm) AS normalized_score,
   coalesce(CASE WHEN coalesce(higher_is_better, false) THEN score - baseline_score
                 ELSE baseline_score - score END, 0.0) AS improvement_from_baseline
 FROM {prefix}_der, {prefix}_med2
)"""


def with_views(body: str, *extra_ctes: str) -> str:
    """Prefix a query with every care view (DuckDB inlines only the referenced ones)."""
    ctes = [f"{name} AS ({sql})" for name, sql in CARE_VIEWS.items()] + list(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body


def mart_query(body: str, period=None, filters=None, *extra_ctes: str) -> str:
    """A query over ``mart`` (and optional extra CTEs defined after it)."""
    return with_views(body, mart_ctes(period, filters), *extra_ctes)
