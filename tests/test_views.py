"""Queries that scan few rows or columns of the outcomes once do not store all of them first (findings of round 3)."""

from __future__ import annotations

import pytest

from caremart.operators import mart as M
from caremart.plans import catalog, materialize
from tests.test_mart import _driver_tables


@pytest.fixture()
def root(spark, tmp_path):
    return _driver_tables(spark, tmp_path)


def _stored(root):
    return [k[1] for k in materialize._WRITTEN if k[2][0] == root]


@pytest.mark.parametrize("name", ["emergency_entry_alerts", "session_audit_rows", "stream_import", "report_cost_summary"])
def test_outcomes_are_not_stored(spark, root, name):
    catalog.REGISTRY[name].build(spark, root).collect()
    assert "outcome_rows" not in _stored(root)


def _below(plan, mark):
    """The subtrees of a plan's text under the lines that hold ``mark``."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for n, line in enumerate(lines):
        if mark in line:
            sub = []
            for other in lines[n + 1:]:
                if depth(other) <= depth(line):
                    break
                sub.append(other)
            yield "\n".join(sub)


def test_mart_shuffles_no_line_items_to_their_individuals(spark, root):
    staged = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        M.outcome_mart(catalog.viewed(spark, root).derived(), stage=lambda df, name: staged.append(df) or df)
        plan = staged[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    subtrees = list(_below(plan, "hashpartitioning(o_custkey"))
    assert subtrees and not [s for s in subtrees if "l_orderkey" in s], plan


def test_mart_refuses_plain_outcomes_without_individuals(spark, root):
    tables = catalog.viewed(spark, root).tables() | {"individuals": None}
    with pytest.raises(ValueError, match="individuals"):
        M.outcome_mart(tables)


def test_stream_import_brings_small_batches_to_the_stored_records(spark, tmp_path, monkeypatch):
    """Both ways skip what is stored or came in an earlier micro-batch; names are resolved once for a run."""
    import datetime as dt

    from caremart.operators import ingest as G
    from caremart.streaming import jobs as SJ
    ind = spark.createDataFrame([(1, "A1"), (0, "A1"), (2, "A2")], "id long, anonymous_id string")
    itv = spark.createDataFrame([("t1", "Art")], "id string, name string")
    met = spark.createDataFrame([("m1", "Mood", 0.0, 10.0)], "id string, name string, scale_min double, scale_max double")
    stored = spark.createDataFrame([(0, "t1", dt.date(2020, 1, 3)), (0, "t1", dt.date(2020, 1, 3)), (None, None, None)],
                                   "individual_id long, intervention_id string, session_date date")
    (tmp_path / "csv").mkdir()
    for n, day in enumerate(("2020-01-03", "2020-01-04", "2020-01-04", "2020-01-05")):
        (tmp_path / "csv" / f"{n}.csv").write_text("individual_anonymous_id,intervention_name,metric_name,score,session_date\n"
                                                   f"A1,Art,Mood,{n},{day}\nA2,Art,Mood,{n},{day}\n")
    resolved = []
    names = G.name_ids
    monkeypatch.setattr(G, "name_ids", lambda *a: resolved.append(1) or names(*a))
    for small in (0, SJ.SMALL):
        monkeypatch.setattr(SJ, "SMALL", small)
        out = SJ.stream_import(spark, str(tmp_path / "csv"), ind, itv, met, stored, out_dir=str(tmp_path / f"out{small}"),
                               max_files=1)
        got = sorted((r["individual_id"], str(r["session_date"])) for r in spark.read.parquet(out).collect())
        assert got == [(0, "2020-01-04"), (0, "2020-01-05"), (2, "2020-01-03"), (2, "2020-01-04"), (2, "2020-01-05")]
        assert spark.read.parquet(SJ.rejects_of(out)).count() == 3
    assert len(resolved) == 2  # once a run, not once for each of its four micro-batches


def test_import_batch_numbers_rows_beyond_a_bigint(spark, tmp_path):
    """F1 of round 4: from 11.5 million orders on a row's number overflowed a BIGINT and the batch could not be read."""
    import datetime as dt
    root = _driver_tables(spark, tmp_path)
    day = dt.datetime(1998, 3, 5)
    keys = [53_999_999, 54_000_000]
    spark.createDataFrame([(o, 1, "O", 1.0, day, "5-LOW") for o in keys], "o_orderkey long, o_custkey long, o_orderstatus string, "
                          "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.mode(
        "overwrite").parquet(f"{root}/orders.parquet")
    spark.createDataFrame([(o, p, 1, n, 7.0, 1.0, 0.0, 0.0, "R", "F", day) for o in keys for p, n in ((1, 1), (3, 1), (2, 2))],
                          spark.read.parquet(f"{root}/lineitem.parquet").schema).write.mode("overwrite").parquet(f"{root}/lineitem.parquet")
    batch = catalog.viewed(spark, root).import_batch.collect()
    assert sorted(int(r["row_num"]) for r in batch) == sorted(
        ((o * 10**7 + p) * 10**4 + 1) * 8 + n for o in keys for p, n in ((1, 1), (3, 1), (2, 2)))
    got = {(r["outcome"], r["reasons"]): r["rows"] for r in catalog.REGISTRY["stream_import_outcomes"].build(spark, root).collect()}
    # two keys: PROMO and SMALL of one customer and day
    assert got == {("imported", ""): 2, ("skipped", "already imported; "): 4, ("read", ""): 6}
    first = catalog.REGISTRY["csv_first_rows_win"].build(spark, root).count()
    assert first == catalog.REGISTRY["stream_import"].build(spark, root).count() == 2
