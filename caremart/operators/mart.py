"""MRT1-MRT9: the cleaned, imputed, direction-normalised outcome mart.

Star join -> attended/period/filters -> global medians and modes of the
*filtered* rows -> derived columns -> second median pass for leftover
normalised scores.  The statistics come back to the driver as a handful of
numbers (never rows) and are applied as literals; the row plan stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.functions.columns import Derived, clamp, sum_skip_nulls
from caremart.functions.quantiles import approx_medians, exact_median_values, mode_values
from caremart.operators.filters import apply_filters, attended, in_period

NUMERIC_IMPUTE = ["cost_per_session", "session_duration", "quality_rating", "direct_cost", "indirect_cost",
                  "overhead_cost", "material_cost", "score", "baseline_score"]
CATEGORICAL_IMPUTE = ["intervention_category", "metric_category", "age_group", "disability_category",
                      "support_level", "staff_name"]
COST_PARTS = ["direct_cost", "indirect_cost", "overhead_cost", "material_cost"]
NUMERIC_COERCE = ["score", "baseline_score", "target_score", "cost_per_session", "scale_min", "scale_max",
                  "direct_cost", "indirect_cost", "overhead_cost", "material_cost", "planned_duration",
                  "session_duration", "quality_rating"]


def _opt(df: DataFrame, name: str, alias: str | None = None, dtype: str = "string"):
    """Column if present, typed NULL otherwise (lets the mart run on partial schemas)."""
    c = F.col(name) if name in df.columns else F.lit(None).cast(dtype)
    return c.alias(alias or name)


# the columns that the mart takes from the outcomes; those with a type may be absent
OUTCOME_COLUMNS = {"id": None, "session_id": None, "individual_id": None, "intervention_id": None,
                   "outcome_metric_id": None, "score": "double", "baseline_score": "double", "target_score": "double",
                   "session_date": None, "session_duration": "double", "attendance_status": None, "staff_id": "string",
                   "notes": "string", "quality_rating": "double", "created_at": "timestamp_ntz",
                   "recorded_by": "string"}
# the columns that it takes from the individuals; all but the name may be absent
INDIVIDUAL_COLUMNS = ["anonymous_id", "age_group", "disability_category", "support_level", "gender",
                      "disability_severity", "funding_source"]


def _star(outcomes: DataFrame | Derived, interventions: DataFrame, metrics: DataFrame, individuals: DataFrame | None,
          staff: DataFrame, costs: DataFrame | Derived, cost_grain: str) -> Derived:
    """The joined rows, still without the columns that outcomes and costs derive from theirs, and all columns."""
    if isinstance(outcomes, Derived):
        o = outcomes.rows
        cols = {c: outcomes.columns.get(c, F.lit(None).cast(t or "string")) for c, t in OUTCOME_COLUMNS.items()}
    else:
        o = outcomes.select(*[_opt(outcomes, c, dtype=t) if t else c for c, t in OUTCOME_COLUMNS.items()])
        cols = {c: F.col(c) for c in OUTCOME_COLUMNS}
    i = interventions.select(
        F.col("id").alias("_i_id"), F.col("name").alias("intervention_name"),
        _opt(interventions, "category", "intervention_category"),
        _opt(interventions, "cost_per_session", dtype="double"),
        _opt(interventions, "duration_minutes", "planned_duration", dtype="double"),
        _opt(interventions, "evidence_level"))
    m = metrics.select(
        F.col("id").alias("_m_id"), F.col("name").alias("metric_name"),
        _opt(metrics, "category", "metric_category"),
        _opt(metrics, "scale_min", dtype="double"), _opt(metrics, "scale_max", dtype="double"),
        _opt(metrics, "higher_is_better", dtype="boolean"),
        _opt(metrics, "clinical_significance_threshold", dtype="double"), _opt(metrics, "unit_of_measure"))
    if individuals is None:
        if not isinstance(outcomes, Derived):
            raise ValueError("only outcomes given as Derived may carry the individuals' columns")
        p = None
        own = {x: outcomes.columns["anonymous_id"] if x == "anonymous_id" else
               outcomes.columns.get(x, F.lit(None).cast("string")) for x in INDIVIDUAL_COLUMNS}
    else:
        p = individuals.select(F.col("id").alias("_p_id"), "anonymous_id",
                               *[_opt(individuals, x) for x in INDIVIDUAL_COLUMNS[1:]])
        own = {x: F.col(x) for x in INDIVIDUAL_COLUMNS}
    u = staff.select(F.col("id").alias("_u_id"), F.col("full_name").alias("staff_name"))
    if cost_grain not in ("row", "session"):
        raise ValueError("cost_grain must be 'row' or 'session'")
    if cost_grain == "row" and isinstance(costs, Derived):
        # an outcome without costs has none: not the values of empty rows
        c, sid = costs.rows.withColumn("_c_here", F.lit(True)), costs.columns["session_id"]
        parts = {x: F.when(F.col("_c_here"), costs.columns.get(x, F.lit(None).cast("double"))) for x in COST_PARTS}
        spent = costs.unused(COST_PARTS)
    else:
        c = costs.frame() if isinstance(costs, Derived) else costs
        c = c.select(F.col("session_id").alias("_c_sid"), *[_opt(c, x, dtype="double") for x in COST_PARTS])
        if cost_grain == "session":
            # one cost row per session: pre-aggregate so several cost rows never fan out metric rows
            c = c.groupBy("_c_sid").agg(*[F.sum(x).alias(x) for x in COST_PARTS])
        sid, parts, spent = F.col("_c_sid"), {x: F.col(x) for x in COST_PARTS}, []
    # The joins that shuffle the outcomes go first, while their rows are narrowest; the other dimension joins (inner,
    # on outcome columns only) follow, so the result equals the written join order of the reference.
    # What the costs' session ids derive from has done its work with the first join.
    rows = o.join(c, cols["session_id"] == sid, "left").drop(*spent)
    if p is not None:
        rows = rows.join(p, cols["individual_id"] == F.col("_p_id"))
    rows = (rows.join(i, cols["intervention_id"] == F.col("_i_id"))
            .join(m, cols["outcome_metric_id"] == F.col("_m_id"))
            .join(u, cols["staff_id"] == F.col("_u_id"), "left")
            .drop("_i_id", "_m_id", "_p_id", "_u_id", "_c_sid"))
    cols |= parts
    for d in (i, m):
        cols |= {x: F.col(x) for x in d.columns[1:]}
    cols |= own | {"staff_name": F.col("staff_name")}
    return Derived(rows, cols)


def outcome_star(outcomes: DataFrame | Derived, interventions: DataFrame, metrics: DataFrame,
                 individuals: DataFrame | None, staff: DataFrame, costs: DataFrame | Derived, cost_grain: str = "row") -> DataFrame:
    """MRT1/JN1: outcomes x interventions x metrics x individuals (inner), staff and costs (left).

    Dimensions are pre-projected so only used columns are scanned.  Join strategy
    is left to Catalyst/AQE: small dimensions broadcast under the size-checked
    ``autoBroadcastJoinThreshold``; the joins with the costs (on ``session_id``) and the
    individuals are sort-merge joins once those are large.  Outcomes and costs given as
    ``Derived`` pass them as their narrow rows, and their columns are derived after the
    joins; the two must have no row column in common.  Without ``individuals`` the outcomes
    (``Derived``) carry the individuals' columns: they were joined where the rows were fewest.
    """
    return _star(outcomes, interventions, metrics, individuals, staff, costs, cost_grain).frame()


def coerce_numeric(df: DataFrame, cols: Sequence[str] = NUMERIC_COERCE) -> DataFrame:
    """MRT2: numeric coercion; text that is not a number becomes NULL."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") if
                           dict(df.dtypes)[c] == "string" else F.col(c).cast("double")
                           for c in cols if c in df.columns})


def impute(df: DataFrame, numeric: Sequence[str] = NUMERIC_IMPUTE,
           categorical: Sequence[str] = CATEGORICAL_IMPUTE, default: str = "Unknown",
           median_strategy: str = "exact", known: dict | None = None) -> DataFrame:
    """MRT3/MRT4: median fill of numeric columns, mode fill (ties -> smallest) of categoricals.

    The statistics are computed over exactly the rows of ``df`` (so a filtered
    mart gets its own medians).  They come back as one number per column and fill
    as literals, so the row plan stays a single codegen'd projection.
    ``median_strategy="approx"`` takes bounded sketches instead of exact medians.
    ``known`` keeps the statistics for the next call over the same rows.
    """
    known = {} if known is None else known
    numeric = [c for c in numeric if c in df.columns]
    categorical = [c for c in categorical if c in df.columns]
    if "medians" not in known:
        known["medians"] = _median_values(df, numeric, median_strategy)
    if "modes" not in known:
        known["modes"] = mode_values(df, categorical)
    fills = {c: F.coalesce(F.col(c), F.lit(m).cast("double")) for c, m in zip(numeric, known["medians"])}
    fills.update({c: F.coalesce(F.col(c), F.lit(m).cast("string"), F.lit(default))
                  for c, m in zip(categorical, known["modes"])})
    return df.withColumns(fills)


def _median_values(df: DataFrame, cols: Sequence[str], strategy: str) -> list[float | None]:
    if strategy == "exact":
        return exact_median_values(df, cols)
    if strategy == "approx":
        return list(approx_medians(df, cols, [f"m{i}" for i in range(len(cols))]).collect()[0])
    raise ValueError(f"unknown median strategy {strategy!r}")


def with_total_cost(df: DataFrame, parts: Sequence[str] = COST_PARTS, out: str = "total_cost") -> DataFrame:
    """MRT5: sum of the cost parts, NULL parts skipped."""
    return df.withColumn(out, sum_skip_nulls(parts))


def with_variances(df: DataFrame) -> DataFrame:
    """MRT6: actual minus planned cost and duration."""
    return df.withColumns({"cost_variance": F.col("total_cost") - F.col("cost_per_session"),
                           "duration_variance": F.col("session_duration") - F.col("planned_duration")})


def normalized_score_expr(score: str = "score", lo: str = "scale_min", hi: str = "scale_max",
                          hib: str = "higher_is_better"):
    """0-10, direction-aware; 5.0 for a degenerate scale; NULL for a NULL scale; clamped."""
    s, a, b = F.col(score), F.col(lo), F.col(hi)
    raw = (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
           .when(b == a, F.lit(5.0))
           .when(F.coalesce(F.col(hib), F.lit(False)), (s - a) / (b - a) * 10)
           .otherwise((b - s) / (b - a) * 10))
    return clamp(raw, 0.0, 10.0)


def normalize_score(df: DataFrame, out: str = "normalized_score", median_strategy: str = "exact",
                    known: dict | None = None) -> DataFrame:
    """MRT7: normalised score; leftover NULLs take the median of the normalised scores (kept in ``known``)."""
    known = {} if known is None else known
    df = df.withColumn(out, normalized_score_expr())
    if "normalized" not in known:
        (known["normalized"],) = _median_values(df, [out], median_strategy)
    return df.withColumn(out, F.coalesce(F.col(out), F.lit(known["normalized"]).cast("double")))


def improvement(df: DataFrame, out: str = "improvement_from_baseline") -> DataFrame:
    """MRT8: score change against baseline in the metric's good direction; NULL -> 0."""
    hib = F.coalesce(F.col("higher_is_better"), F.lit(False))
    diff = F.when(hib, F.col("score") - F.col("baseline_score")).otherwise(F.col("baseline_score") - F.col("score"))
    return df.withColumn(out, F.coalesce(diff, F.lit(0.0)))


MART_COLUMNS = [
    "id", "session_id", "individual_id", "intervention_id", "outcome_metric_id", "session_date",
    "attendance_status", "staff_id", "notes", "created_at", "score", "baseline_score", "target_score",
    "session_duration", "quality_rating", "intervention_name", "intervention_category", "cost_per_session",
    "planned_duration", "evidence_level", "metric_name", "metric_category", "scale_min", "scale_max",
    "higher_is_better", "clinical_significance_threshold", "unit_of_measure", "anonymous_id", "age_group",
    "disability_category", "support_level", "gender", "disability_severity", "funding_source", "staff_name",
    "recorded_by",
    "direct_cost", "indirect_cost", "overhead_cost", "material_cost", "total_cost", "cost_variance",
    "duration_variance", "normalized_score", "improvement_from_baseline",
]


def outcome_mart(tables: Mapping[str, DataFrame | Derived | None], period: tuple | None = None,
                 filters: Mapping[str, object] | None = None, cost_grain: str = "row",
                 median_strategy: str = "exact",
                 stage: Callable[[DataFrame, str], DataFrame] | None = None, known: dict | None = None) -> DataFrame:
    """MRT9: the whole mart for an optional period and optional equality filters.

    ``tables`` holds ``outcomes, interventions, metrics, individuals, staff, costs``;
    outcomes and costs may be ``Derived``, and such outcomes may carry the individuals' columns (``individuals`` None).
    Medians/modes are computed after the period and filters (reference
    semantics); filter the returned frame to narrow *after* imputation.
    ``stage`` (e.g. ``materialize.write_stage``) writes the rows of the filtered star
    join once so the statistics passes scan them instead of re-running the joins; the
    mart is a projection of what it wrote.  ``known`` keeps the statistics, for the next
    call over the same stage.
    """
    outcomes = Derived.of(tables["outcomes"]).where(attended)
    if period:
        outcomes = outcomes.where(lambda df: in_period(df, period[0], period[1]))
    if not isinstance(tables["outcomes"], Derived):
        outcomes = outcomes.frame()
    star = _star(outcomes, tables["interventions"], tables["metrics"], tables["individuals"],
                 tables["staff"], tables["costs"], cost_grain)
    if filters:
        star = star.where(lambda df: apply_filters(df, filters))
    if stage is not None:
        star = star._replace(rows=stage(star.rows, "star"))
    mart = coerce_numeric(star.frame())
    mart = with_variances(with_total_cost(impute(mart, median_strategy=median_strategy, known=known)))
    mart = improvement(normalize_score(mart, median_strategy=median_strategy, known=known))
    return mart.select(*MART_COLUMNS)
