"""Filters, labels, schedules, rankings and the presence matrix on hand-made rows."""

import datetime as dt

from caremart.operators import aggregates as A
from caremart.operators import filters as FL
from caremart.operators import individuals as I
from caremart.operators import ranking as R


def test_filters_and_search(spark):
    df = spark.createDataFrame([("Art", "18-30", "Good progress", "Ann"), ("Music", "31-45", None, "Bob"),
                                ("Art", "31-45", "a.b", None)],
                               "intervention_name string, age_group string, notes string, staff_name string")
    assert FL.apply_filters(df, {"intervention": "Art", "age_group": "All"}).count() == 2
    assert FL.apply_filters(df, {"age_group": ["18-30", "31-45"], "staff": None}).count() == 3
    assert [r["staff_name"] for r in FL.search(df, ["notes", "staff_name"], "PROGRESS").collect()] == ["Ann"]
    # literal by default: '.' is not a wildcard; regex=True makes it one
    assert FL.search(df, ["notes"], "a.b").count() == 1
    assert FL.search(df, ["notes"], "o.d", regex=True).count() == 1
    ind = spark.createDataFrame([("A1", "18-30", "Autism", "Mild"), ("A2", None, None, None)],
                                "anonymous_id string, age_group string, disability_category string, "
                                "disability_severity string")
    labels = [r["label"] for r in FL.individual_label(ind).orderBy("anonymous_id").collect()]
    assert labels == ["A1 - 18-30, Autism (Mild)", "A2 - Unknown Age, Unknown Disability"]


def test_next_due_and_overdue(spark):
    s = spark.createDataFrame([("s1", "p", "m", "Weekly", dt.date(2020, 1, 1)),
                               ("s2", "p", "m", "Quarterly", dt.date(2020, 1, 1))],
                              "id string, individual_id string, outcome_metric_id string, frequency string, "
                              "start_date date")
    due = {r["id"]: r["next_due_date"] for r in I.next_due(s).collect()}
    assert due == {"s1": dt.date(2020, 1, 8), "s2": dt.date(2020, 3, 31)}
    ind = spark.createDataFrame([("p", "A1")], "id string, anonymous_id string")
    met = spark.createDataFrame([("m", "Mood")], "id string, name string")
    lst = I.schedule_list(I.next_due(s), ind, met, dt.date(2020, 2, 1)).collect()
    assert [(r["id"], r["overdue"]) for r in lst] == [("s1", True), ("s2", False)]


def test_rankings_and_top_bottom(spark):
    df = spark.createDataFrame([("a", 0.3), ("b", 0.1), ("c", 0.3), ("d", 0.2), ("e", None)],
                               "intervention_name string, efficiency_ratio double")
    ranks = {r["intervention_name"]: r["rank"] for r in R.rank_by(df, "efficiency_ratio").collect()}
    assert ranks == {"a": 1, "c": 2, "d": 3, "b": 4, "e": 5}
    tb = R.top_bottom(df, "efficiency_ratio").collect()[0]
    assert tb["top_performers"] == "a, c, d"
    assert tb["bottom_performers"] == "b, e"
    top = [r["intervention_name"] for r in R.top_k(df, "efficiency_ratio", 2, tie="intervention_name").collect()]
    assert top == ["a", "c"]


def test_top_n_per_key_is_exact_with_a_hot_key(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, t long")
    from pyspark.sql import functions as F
    got = sorted((r["k"], r["t"]) for r in R.top_n_per_key(df, ["k"], [F.desc("t")], 4, salt_buckets=8).collect())
    assert got == sorted([("hot", 4999), ("hot", 4998), ("hot", 4997), ("hot", 4996),
                          ("cold", 2), ("cold", 1), ("cold", 0)])


def test_presence_matrix(spark):
    df = spark.createDataFrame([("Admin", "Export"), ("Admin", "Delete"), ("Staff", "Export")],
                               "role string, permission string")
    m = {r["role"]: (r["Export"], r["Delete"]) for r in A.presence_matrix(df, "role", "permission").collect()}
    assert m == {"Admin": (True, True), "Staff": (True, False)}
