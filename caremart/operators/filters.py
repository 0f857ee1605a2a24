"""FLT1-FLT14: projections, filters and predicates.

"Today" is always an explicit ``as_of`` argument so results are reproducible.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Filter keys of the mart and the column each one constrains.
FILTER_COLUMNS = {
    "intervention": "intervention_name",
    "age_group": "age_group",
    "disability": "disability_category",
    "staff": "staff_name",
    "role": "role",
    "metric": "metric_name",
}


def attended(df: DataFrame, status_col: str = "attendance_status", value: str = "attended") -> DataFrame:
    """FLT1: the base filter of the mart."""
    return df.where(F.col(status_col) == value)


def in_period(df: DataFrame, start=None, end=None, col: str = "session_date") -> DataFrame:
    """FLT2: optional inclusive date range; either bound may be None."""
    c = F.col(col)
    if start is not None:
        df = df.where(c >= F.lit(start))
    if end is not None:
        df = df.where(c <= F.lit(end))
    return df


def apply_filters(df: DataFrame, filters: Mapping[str, object] | None,
                  columns: Mapping[str, str] = FILTER_COLUMNS) -> DataFrame:
    """FLT3/FLT5/FLT6: equality (or ``isin`` for lists); None / "All" means no filter."""
    for key, value in (filters or {}).items():
        if value is None or value == "All":
            continue
        c = F.col(columns.get(key, key))
        if isinstance(value, (list, tuple, set, frozenset)):
            df = df.where(c.isin(list(value)))
        else:
            df = df.where(c == F.lit(value))
    return df


def search(df: DataFrame, cols: Sequence[str], text: str, regex: bool = False) -> DataFrame:
    """FLT4: case-insensitive substring (or regex) match on any of ``cols``; NULL never matches."""
    if not text:
        return df
    conds: list[Column] = []
    for c in cols:
        s = F.col(c).cast("string")
        if regex:
            conds.append(F.coalesce(s.rlike("(?i)" + text), F.lit(False)))
        else:
            conds.append(F.coalesce(F.lower(s).contains(text.lower()), F.lit(False)))
    cond = conds[0]
    for c in conds[1:]:
        cond = cond | c
    return df.where(cond)


def out_of_range(df: DataFrame, score: str = "score", lo: str = "scale_min", hi: str = "scale_max") -> DataFrame:
    """FLT7: score below the metric's minimum or above its maximum."""
    return df.where((F.col(score) < F.col(lo)) | (F.col(score) > F.col(hi)))


def future_dated(df: DataFrame, as_of, col: str = "session_date") -> DataFrame:
    """FLT8: rows dated after ``as_of``."""
    return df.where(F.col(col) > F.lit(as_of))


def low_quality_log(mart: DataFrame, threshold: float = 3,
                    cols: Sequence[str] = ("session_date", "individual_id", "intervention_name", "staff_name",
                                           "quality_rating", "notes")) -> DataFrame:
    """FLT9: sessions rated below ``threshold`` with a log projection."""
    return mart.where(F.col("quality_rating") < threshold).select(*[c for c in cols if c in mart.columns])


def individual_label(df: DataFrame, id_col: str = "anonymous_id", out: str = "label") -> DataFrame:
    """FLT13: ``id - age, disability (severity)`` with defaults for missing parts."""
    sev = F.col("disability_severity") if "disability_severity" in df.columns else F.lit(None).cast("string")
    disability = F.coalesce(F.col("disability_category"), F.lit("Unknown Disability"))
    label = F.concat(F.col(id_col).cast("string"), F.lit(" - "),
                     F.coalesce(F.col("age_group"), F.lit("Unknown Age")), F.lit(", "), disability,
                     F.when(sev.isNotNull(), F.concat(F.lit(" ("), sev, F.lit(")"))).otherwise(F.lit("")))
    return df.withColumn(out, label)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """FLT14: sorted distinct non-null values of a column (picker lists)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
