"""RPT1-RPT7, SNK1, SNK6: report assembly and exports.

A report is an ordered ``{section: DataFrame}``; charts of the reference are
their data frames, and every section is a lazy frame over the written mart.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caremart.operators import aggregates as A
from caremart.operators import ranking as R
from caremart.operators import stats as ST
from caremart.operators.filters import low_quality_log
from caremart.sources.csv import write_csv


def executive_recommendations(analysis: DataFrame, name: str = "intervention_name",
                              col: str = "efficiency_ratio") -> DataFrame:
    """RPT1 (D4 fix): the most and least efficient intervention by efficiency, not by name."""
    return analysis.agg(F.max_by(name, F.struct(F.col(col), F.col(name))).alias("expand"),
                        F.min_by(name, F.struct(F.col(col), F.col(name))).alias("review"))


def executive_report(mart: DataFrame) -> dict[str, DataFrame]:
    """RPT1: KPIs, interventions by outcome, trend, top 3 / bottom 2 and recommendations."""
    ia = A.intervention_analysis(mart)
    return {"kpis": A.executive_kpis(mart),
            "intervention_analysis": ia.orderBy(F.desc("efficiency_ratio"), "intervention_name"),
            "trend": A.monthly_trend(mart).orderBy("year_month"),
            "performance_summary": R.top_bottom(ia, "efficiency_ratio"),
            "recommendations": executive_recommendations(ia)}


def intervention_report(mart: DataFrame, alpha: float = 0.05) -> dict[str, DataFrame]:
    """RPT2: efficiency ranking and the significantly different pairs."""
    ia = A.intervention_analysis(mart)
    sig = ST.pairwise_significance(mart, alpha=alpha)
    return {"ranking": R.rank_by(ia, "efficiency_ratio").orderBy("rank"),
            "significant_pairs": ST.label_significance(sig.where(F.col("significant")))}


def cost_report(mart: DataFrame) -> dict[str, DataFrame]:
    """RPT3: financial summary, cost share and cost per outcome point."""
    return {"cost_efficiency": A.cost_efficiency(A.intervention_analysis(mart), decimals=2),
            "summary": A.cost_summary(mart), "cost_share": A.cost_share(mart)}


def quality_report(mart: DataFrame, records: DataFrame | None = None) -> dict[str, DataFrame]:
    """RPT4: quality KPIs, quality by staff, rating histogram and the low-quality log."""
    return {"low_quality_log": low_quality_log(mart, cols=("session_date", "anonymous_id", "intervention_name",
                                                           "staff_name", "quality_rating")),
            "quality_metrics": A.quality_metrics(mart, records),
            "quality_by_staff": A.quality_by_staff(mart),
            "rating_histogram": A.histogram(mart, "quality_rating", 5)}


def individual_report_set(mart: DataFrame, anonymous_id: str) -> dict[str, DataFrame]:
    """RPT5: one individual's performance by intervention and progress timeline."""
    one = mart.where(F.col("anonymous_id") == anonymous_id)
    return {"by_intervention": A.individual_report(mart, anonymous_id),
            "timeline": R.progress_timeline(one)}


def staff_report(mart: DataFrame, staff_name: str | None = None) -> dict[str, DataFrame]:
    """RPT6: the staff leaderboard, or one staff member's summary."""
    if staff_name is None:
        return {"leaderboard": A.staff_analysis(mart).orderBy(F.desc("quality_rating"), "staff_name")}
    return {"summary": A.staff_summary(mart, staff_name)}


def regulatory_report(mart: DataFrame, goals: DataFrame) -> dict[str, DataFrame]:
    """RPT7: service log, delivery summary and compliance measures."""
    return {"service_log": R.service_log(mart),
            "service_summary": A.service_summary(mart),
            "goal_compliance": A.goal_compliance(mart, goals),
            "notes_compliance": A.notes_compliance(mart)}


REPORTS = {"Executive Summary": executive_report, "Intervention Effectiveness": intervention_report,
           "Cost Analysis": cost_report, "Quality Assurance": quality_report,
           "Individual Progress": individual_report_set, "Staff Performance": staff_report,
           "Regulatory Compliance": regulatory_report}


def run_report(name: str, mart: DataFrame, **kwargs) -> dict[str, DataFrame]:
    """Build a named report; its sections are lazy frames over the (written) mart."""
    return REPORTS[name](mart, **kwargs)


def write_report_csv(report: Mapping[str, DataFrame], path: str, single_file: bool = False) -> list[str]:
    """SNK1: write every section of the report as UTF-8 CSV with a header (no index), each in its own folder.

    Quotes are doubled, and cells with quotes, commas or line breaks quoted (RFC 4180).

    Sections may be as large as the facts (logs), so they are written by their
    tasks and never collected.  ``single_file=True`` coalesces to one part file, for
    small reports only.
    """
    for name, df in report.items():
        out = df.coalesce(1) if single_file else df
        write_csv(out, f"{path}/{name}", "overwrite")
    return list(report)


def parse_code_map(text: str) -> list[tuple[str, str]]:
    """SNK6 helper: ``name: code`` lines -> pairs (blank or malformed lines skipped)."""
    pairs = []
    for line in text.splitlines():
        if ": " in line:
            k, v = line.split(": ", 1)
            if k.strip():
                pairs.append((k.strip(), v.strip()))
    return pairs


def billing_export(mart: DataFrame, code_map: str,
                   cols=("session_date", "anonymous_id", "intervention_name", "session_duration", "total_cost")
                   ) -> DataFrame:
    """SNK6: sessions with the billing code of their intervention (NULL when unmapped).

    The map comes from user text that the driver has parsed, so it is small, which Catalyst does not know of a list:
    it is broadcast, and the sessions are not dealt by their few interventions.
    """
    pairs = parse_code_map(code_map)
    spark = mart.sparkSession
    schema = "intervention_name string, billing_code string"
    m = spark.createDataFrame(pairs, schema).dropDuplicates(["intervention_name"])
    return mart.select(*cols, "id").join(F.broadcast(m), "intervention_name", "left")
