"""Structure of the query registry: every SQL-checked query snaps the same double columns on both sides."""

import pytest

import __spark_entry__ as E
from caremart.plans.registry import REGISTRY

EAGER = {"outcome_model", "stream_daily_event_counts", "stream_lockouts", "stream_dedupe_events", "stream_import",
         "csv_first_rows_win", "csv_outcomes", "csv_individuals", "csv_interventions", "csv_mapped_assessments"}


def test_registry_shape():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 100
    assert all(spec.survey_ids for spec in REGISTRY.values())


@pytest.mark.parametrize("name", sorted(n for n, s in REGISTRY.items() if s.sql and n not in EAGER))
def test_double_columns_declared(spark, name):
    df = REGISTRY[name].build(spark, "/root/testdata/sf0.001")
    doubles = {c for c, t in df.dtypes if t in ("double", "float")}
    assert doubles == set(REGISTRY[name].doubles), name
