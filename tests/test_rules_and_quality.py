"""Rule scoring goldens, duplicates, dedupe idempotence."""

import datetime as dt

from pyspark.sql import functions as F

from caremart.operators import quality as Q
from caremart.plans.reports import billing_export


def test_rule_score_goldens(spark):
    cases = {"short": (1, "Very Weak", False), "password": (2, "Weak", False), "Password123": (4, "Strong", True),
             "Password123!": (5, "Very Strong", True), "P@ssw0rd123!": (5, "Very Strong", True),
             "MySecureP@ss1": (5, "Very Strong", True), "nouppercase123": (3, "Medium", False)}
    df = spark.createDataFrame([(k,) for k in cases], "pw string")
    got = {r["pw"]: (r["rule_score"], r["rule_label"], r["rule_valid"], r["rule_unmet"])
           for r in Q.rule_score(df, "pw").collect()}
    for k, (s, label, valid) in cases.items():
        assert got[k][:3] == (s, label, valid), k
    assert set(got["nouppercase123"][3]) == {"uppercase", "special"}


def _records(spark):
    d = dt.date(2020, 1, 1)
    rows = [("a", "p", "t", d, dt.datetime(2020, 1, 1, 9)), ("b", "p", "t", d, dt.datetime(2020, 1, 1, 8)),
            ("c", "p", "t", d, dt.datetime(2020, 1, 1, 10)), ("d", "q", "t", d, dt.datetime(2020, 1, 1, 9))]
    return spark.createDataFrame(rows, "id string, individual_id string, intervention_id string, session_date date, "
                                 "created_at timestamp_ntz")


def test_duplicates_and_dedupe(spark):
    r = _records(spark)
    g = Q.duplicate_groups(r).collect()
    assert [(x["individual_id"], x["count"]) for x in g] == [("p", 3)]
    from pyspark.sql import functions as F
    ov = Q.dq_overview(r.withColumn("outcome_metric_id", r.id).withColumn("score", F.lit(1.0)),
                       spark.createDataFrame([], "id string, name string, scale_min double, scale_max double"),
                       dt.date(2021, 1, 1)).collect()[0]
    assert ov["duplicates"] == 2
    once = Q.dedupe_keep_first(r)
    assert sorted(x["id"] for x in once.collect()) == ["b", "d"]
    twice = Q.dedupe_keep_first(once)
    assert sorted(x["id"] for x in twice.collect()) == ["b", "d"]
    assert sorted(x["id"] for x in Q.removed_duplicates(r).collect()) == ["a", "c"]


def test_billing_map_does_not_shuffle_the_sessions(spark):
    mart = spark.range(1000).select(
        "id", F.lit("2020-01-01").cast("date").alias("session_date"), F.col("id").cast("string").alias("anonymous_id"),
        F.when(F.col("id") % 10 < 8, "PROMO").when(F.col("id") % 10 == 8, "O'Hara \\n").alias("intervention_name"),
        F.lit(30.0).alias("session_duration"), F.lit(1.0).alias("total_cost"))
    out = billing_export(mart, "PROMO: 97530\nO'Hara \\n: 1\nPROMO: 97530\nother: 2")
    codes = {r["billing_code"]: r["n"] for r in out.groupBy("billing_code").agg(F.count("*").alias("n")).collect()}
    assert codes == {"97530": 800, "1": 100, None: 100}
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
