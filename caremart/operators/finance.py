"""AGG37, AGG38, AGG41: budget status, prorated budget vs actual, and cost by intervention."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ("direct_cost", "indirect_cost", "overhead_cost", "material_cost")


def row_cost(parts: Sequence[str] = PARTS, null_as_zero: bool = False):
    """Cost of a record as ``a + b + c + d``: a NULL part drops the row (reference SQL) unless ``null_as_zero``."""
    cols = [F.coalesce(F.col(p).cast("double"), F.lit(0.0)) if null_as_zero else F.col(p).cast("double")
            for p in parts]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def fiscal_year(date_col: str, start_month: int = 1) -> "F.Column":
    """Fiscal year of a date: the calendar year (reference default) or, with a later
    ``start_month``, the year in which the fiscal year started."""
    d = F.col(date_col)
    if start_month == 1:
        return F.year(d)
    return F.when(F.month(d) >= start_month, F.year(d)).otherwise(F.year(d) - 1)


def budget_status(costs: DataFrame, budgets: DataFrame, year: int | None = None,
                  null_as_zero: bool = False, date_col: str = "cost_date", start_month: int = 1) -> DataFrame:
    """AGG37: total budget, spend, remaining and % spent per fiscal year.

    ``year=None`` reports every budget year in one pass over the costs.  The
    fiscal year is the calendar year unless ``start_month`` says otherwise (D13).
    """
    c = costs.select(fiscal_year(date_col, start_month).alias("fiscal_year"),
                     row_cost(null_as_zero=null_as_zero).alias("_cost"))
    b = budgets.select(F.col("fiscal_year").cast("int"), F.col("total_budget").cast("double"))
    if year is not None:
        c, b = c.where(F.col("fiscal_year") == year), b.where(F.col("fiscal_year") == year)
    spend = c.groupBy("fiscal_year").agg(F.sum("_cost").alias("ytd_spending"))
    j = b.join(spend, "fiscal_year", "left")
    spent = F.coalesce(F.col("ytd_spending"), F.lit(0.0))
    tb = F.coalesce(F.col("total_budget"), F.lit(0.0))
    return j.select("fiscal_year", tb.alias("total_budget"), spent.alias("ytd_spending"),
                    (tb - spent).alias("remaining_budget"),
                    F.when(tb > 0, spent / tb * 100).otherwise(F.lit(0.0)).alias("percent_spent"))


def year_length(year_col) -> "F.Column":
    """Days in a year (leap-aware) as the day-of-year of 31 December."""
    return F.dayofyear(F.make_date(year_col, F.lit(12), F.lit(31)))


def budget_vs_actual(costs: DataFrame, budgets: DataFrame, start: _dt.date, end: _dt.date,
                     null_as_zero: bool = False, date_col: str = "cost_date") -> DataFrame:
    """AGG38: budget of ``start``'s year prorated to the inclusive day range, actual spend and variance."""
    fy = start.year
    b = budgets.where(F.col("fiscal_year") == fy).agg(F.max(F.col("total_budget").cast("double")).alias("annual"))
    a = (costs.where(F.col(date_col).between(F.lit(start), F.lit(end)))
         .agg(F.sum(row_cost(null_as_zero=null_as_zero)).alias("actual")))
    days = (end - start).days + 1
    annual = F.coalesce(F.col("annual"), F.lit(0.0))
    prorated = F.when(annual > 0, annual / year_length(F.lit(fy)) * days).otherwise(F.lit(0.0))
    actual = F.coalesce(F.col("actual"), F.lit(0.0))
    return b.crossJoin(a).select(  # one row x one row
        F.lit(fy).alias("fiscal_year"), annual.alias("annual_budget"), F.lit(days).alias("days_in_range"),
        prorated.alias("prorated_budget"), actual.alias("actual_spending"), (prorated - actual).alias("variance"))


def cost_by_intervention(costs: DataFrame, interventions: DataFrame, null_as_zero: bool = True) -> DataFrame:
    """AGG41: direct, overhead and total cost per intervention (the actual-cost side of the P&L)."""
    i = interventions.select(F.col("id").alias("intervention_id"), F.col("name").alias("intervention"))
    g = costs.groupBy("intervention_id").agg(
        F.sum("direct_cost").alias("direct_costs"), F.sum("overhead_cost").alias("overhead_allocation"),
        F.sum(row_cost(null_as_zero=null_as_zero)).alias("total_cost"))
    return g.join(i, "intervention_id").select("intervention", "direct_costs", "overhead_allocation", "total_cost")
