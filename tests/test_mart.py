"""Hand-made cases of the outcome mart (imputation, normalisation, direction)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caremart.functions.quantiles import exact_medians, modes
from caremart.operators import mart as M


def _tables(spark, outcomes, metrics, costs=None):
    o = spark.createDataFrame(outcomes, "id string, individual_id string, intervention_id string, "
                              "outcome_metric_id string, score double, baseline_score double, "
                              "session_date date, session_duration int, attendance_status string, "
                              "staff_id string, quality_rating int")
    o = o.withColumn("session_id", F.col("id"))
    i = spark.createDataFrame([("T", "T", "Therapy", 50.0, 60)],
                              "id string, name string, category string, cost_per_session double, duration_minutes int")
    m = spark.createDataFrame(metrics, "id string, name string, category string, scale_min double, "
                              "scale_max double, higher_is_better boolean")
    p = spark.createDataFrame([("P1", "A1", "18-30", None, "L1")],
                              "id string, anonymous_id string, age_group string, disability_category string, "
                              "support_level string")
    u = spark.createDataFrame([("S1", "Staff One")], "id string, full_name string")
    c = spark.createDataFrame(costs or [], "session_id string, direct_cost double, indirect_cost double, "
                              "overhead_cost double, material_cost double")
    return {"outcomes": o, "interventions": i, "metrics": m, "individuals": p, "staff": u, "costs": c}


D = dt.date(2020, 1, 1)


def _row(i, metric, score, base=0.0):
    return (f"r{i}", "P1", "T", metric, score, base, D, 60, "attended", "S1", 4)


METRICS = [("HI", "hi", "c", 0.0, 10.0, True), ("LO", "lo", "c", 0.0, 10.0, False),
           ("DEG", "deg", "c", 10.0, 10.0, True), ("NUL", "nul", "c", None, None, True)]


def test_normalise_cases(spark):
    rows = [_row(1, "HI", 5.0), _row(2, "LO", 2.0), _row(3, "HI", 12.0), _row(4, "DEG", 3.0), _row(5, "NUL", 4.0)]
    mart = M.outcome_mart(_tables(spark, rows, METRICS))
    got = {r["id"]: r["normalized_score"] for r in mart.collect()}
    assert got["r1"] == 5.0
    assert got["r2"] == 8.0
    assert got["r3"] == 10.0
    assert got["r4"] == 5.0
    # null scale -> median of the other normalised scores (5, 8, 10, 5) = 6.5
    assert got["r5"] == 6.5
    assert all(0.0 <= v <= 10.0 for v in got.values())


def test_improvement_direction(spark):
    rows = [_row(1, "HI", 7.0, 5.0), _row(2, "LO", 7.0, 5.0)]
    mart = M.outcome_mart(_tables(spark, rows, METRICS))
    got = {r["id"]: r["improvement_from_baseline"] for r in mart.collect()}
    assert got == {"r1": 2.0, "r2": -2.0}


def test_missing_cost_row_gets_medians(spark):
    rows = [_row(1, "HI", 5.0), _row(2, "HI", 6.0), _row(3, "HI", 7.0)]
    costs = [("r1", 10.0, 0.0, 1.0, 1.0), ("r2", 20.0, 0.0, 3.0, 1.0)]
    mart = M.outcome_mart(_tables(spark, rows, METRICS, costs))
    r3 = [r for r in mart.collect() if r["id"] == "r3"][0]
    assert r3["direct_cost"] == 15.0 and r3["overhead_cost"] == 2.0
    assert r3["total_cost"] == 15.0 + 0.0 + 2.0 + 1.0


def test_imputation_after_filters(spark):
    rows = [_row(1, "HI", 1.0), _row(2, "HI", 9.0), _row(3, "HI", None)]
    rows[1] = rows[1][:6] + (dt.date(2021, 1, 1),) + rows[1][7:]
    t = _tables(spark, rows, METRICS)
    all_rows = {r["id"]: r["score"] for r in M.outcome_mart(t).collect()}
    assert all_rows["r3"] == 5.0
    only_2020 = {r["id"]: r["score"] for r in M.outcome_mart(t, period=(D, D)).collect()}
    assert only_2020["r3"] == 1.0


def test_median_and_mode_semantics(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "b"), (None, "b"), (None, None)], "x double, c string")
    assert exact_medians(df, ["x"]).collect()[0]["x"] == 1.5
    assert modes(df, ["c"]).collect()[0]["c"] == "a"
    empty = spark.createDataFrame([(None,)], "c string")
    assert modes(empty, ["c"]).collect()[0]["c"] is None


def test_all_null_category_becomes_unknown(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "score double, age_group string")
    out = M.impute(df, numeric=["score"], categorical=["age_group"])
    assert {r["age_group"] for r in out.collect()} == {"Unknown"}


@pytest.mark.parametrize("n", [1, 2, 7, 200, 5001])
def test_exact_medians_match_numpy(spark, n, monkeypatch):
    from caremart.functions import quantiles
    import numpy as np
    monkeypatch.setattr(quantiles, "BINS", 16)  # several refinements
    rng = np.random.default_rng(n)
    cols = {"a": rng.integers(0, 50, n).astype(float), "b": rng.normal(size=n),
            "c": np.where(rng.random(n) < 0.8, 0.0, rng.pareto(0.3, n)), "d": np.full(n, 1e308) * rng.choice([-1, 1], n)}
    rows = [tuple(float(v[i]) if (i + j) % 5 else None for j, v in enumerate(cols.values())) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = quantiles.exact_median_values(df, list(cols))
    for j, g in enumerate(got):
        vals = sorted(r[j] for r in rows if r[j] is not None)
        k = len(vals)
        want = (vals[(k - 1) // 2] / 2 + vals[k // 2] / 2) if k else None
        assert g == want if want is None or abs(want) == 1e308 else g == pytest.approx(want)
    one = exact_medians(df, list(cols)).collect()
    assert len(one) == 1 and list(one[0]) == got


def test_quantiles_of_any_doubles_end_in_few_passes(spark, monkeypatch):
    """Infinities, spreads of 300 decades, subnormals, neighbouring doubles and ties."""
    import math
    import random
    from caremart.functions import quantiles
    inf, rnd = float("inf"), random.Random(1)
    groups = {"infinite": [3.0, 2.0, 1.0, -inf], "both": [inf, -inf, 0.0, 5.0, inf], "all": [inf] * 3,
              "wide": [10.0 ** e for e in range(-150, 141, 10)], "signed": [s * 10.0 ** e for e in range(-300, 301, 7) for s in (1, -1)],
              "tiny": [5e-324 * k for k in range(9)], "near": [1.0 + k * 2.0 ** -52 for k in range(40)] + [1e300, -1e300],
              "random": [rnd.gauss(0, 1) * 10 ** rnd.randrange(-9, 9) for _ in range(301)], "ties": [2.5] * 50 + [-0.0, 0.0, 7.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", float("nan")), ("none", None)]
    passes = []
    write = quantiles.write_stage
    monkeypatch.setattr(quantiles, "write_stage", lambda df, name: passes.append(name) or write(df, name))
    got = {r["g"]: (r["a"], r["m"]) for r in quantiles.exact_quantiles(
        spark.createDataFrame(rows, "g string, x double"), ["g"], "x", [0.25, 0.5], ["a", "m"]).collect()}
    assert len(passes) - 1 <= quantiles.PASSES

    def quantile(xs, p):
        xs, at = sorted(xs), (len(xs) - 1) * p
        lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
        return lo if lo == hi else lo * (1 - at % 1) + hi * (at % 1)
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        for p, q in zip((0.25, 0.5), got[g]):
            want = quantile(xs, p)
            assert q == want or (math.isnan(q) and math.isnan(want)), (g, p)


def test_quantiles_collect_no_values(spark):
    """A column of ties is counted, not gathered: no collect_list, and two passes are enough."""
    import inspect
    from caremart.functions import quantiles
    assert "collect_list" not in inspect.getsource(quantiles)
    df = spark.range(100_000).selectExpr("if(id % 10 < 8, 0.0D, cast(id as double)) AS x")
    assert quantiles.exact_median_values(df, ["x"]) == [0.0]


def test_prefix_sums_match_window_with_hot_key(spark):
    from pyspark.sql import Window
    from caremart.functions.prefix import prefix_sums, row_index
    rows = [("hot", i, i % 3) for i in range(3000)] + [(f"k{i % 7}", i, 1) for i in range(200)]
    rows += [(None, i, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = {(r["k"], r["t"]): r["v_cum"] for r in prefix_sums(df, ["k"], ["t"], ["v"],
                                                                           partitions=16).collect()}
    w = Window.partitionBy("k").orderBy("t")
    exp = {(r["k"], r["t"]): r["c"] for r in df.withColumn("c", F.sum("v").over(w)).collect()}
    assert got == exp
    idx = {(r["k"], r["t"]): r["_idx"] for r in row_index(df, ["k"], ["t"], partitions=8).collect()}
    assert idx[("hot", 0)] == 0 and idx[("hot", 2999)] == 2999


def test_describe_matches_numpy(spark):
    import numpy as np
    from caremart.operators.aggregates import describe_by
    rng = np.random.default_rng(7)
    rows = [("hot", float(x)) for x in rng.normal(size=4001)] + [("b", float(x)) for x in rng.integers(0, 9, 10)]
    rows += [("empty", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in describe_by(df, "g", "v").collect()}
    assert set(got) == {"hot", "b", "empty"} and got["empty"]["p50"] is None
    for g in ("hot", "b"):
        vals = np.array([v for k, v in rows if k == g])
        for col, p in (("p25", 25), ("p50", 50), ("p75", 75)):
            assert got[g][col] == pytest.approx(np.percentile(vals, p))
    whole = describe_by(df, None, "v").collect()[0]
    assert whole["p50"] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def _driver_tables(spark, root):
    """Small driver tables with nulls, an unknown part and order, and two line items of one session."""
    ts = dt.datetime
    day = lambda d: ts(1998, 3, d)
    lines = [(o, p, s, n, q, 1000.0 * o + p, 0.05, 0.02, "N", "O", day(1 + (o + p) % 28))
             for o in range(2, 40) for p, s, n, q in ((o % 13, o % 5, 1 + o % 7, float(o % 30)), (10, 3, 2, 13.0))]
    lines += [lines[0], (3, 5, None, 4, None, None, 0.0, 0.0, "R", None, None), (None, 5, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", day(2)),
              (4, 99, 1, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", day(2)), (4, 7, 7, 5, 8.0, 90.0, None, 0.1, "A", "F", day(3))]
    data = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                            "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                            "l_linestatus string, l_shipdate timestamp_ntz"),
        "orders": ([(o, o % 6, "O", 1.0, day(1), "5-LOW") for o in range(1, 40)], "o_orderkey long, o_custkey long, "
                   "o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "part": ([(p, "x", "b", "PROMO" if p % 2 else "SMALL", p, 1.0) for p in range(14)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "customer": ([(c, f"C{c}", c % 2, 1.0, "FURNITURE" if c == 2 else "BUILDING") for c in range(5)],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(s, f"S{s}", 0, 1.0) for s in range(4)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(0, "n0", 0), (1, "n1", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "r0")], "r_regionkey int, r_name string")}
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_mart_of_narrow_rows_is_the_mart_of_the_tables(spark, tmp_path):
    from caremart.plans import catalog
    from caremart.sources.adapter import CareTables
    root = _driver_tables(spark, tmp_path)
    plain = lambda df: sorted(map(repr, df.collect()))
    for kw in ({}, {"period": ("1998-03-05", "1998-03-25"), "filters": {"age_group": "31-45", "staff": "All"}},
               {"cost_grain": "session"}):
        want = plain(M.outcome_mart(CareTables(spark, root).tables(), **kw))
        assert len(want) > 5
        for _ in range(2):  # the second time from what is kept
            assert plain(catalog.mart(spark, root, **kw)) == want
    whole = M.outcome_mart(CareTables(spark, root).tables())
    assert whole.where("session_id LIKE '%-10-%'").count() > 0
    # an outcome without costs takes the medians, no cost derived from an empty row
    parts = M.outcome_star(**{k: v for k, v in CareTables(spark, root).derived().items()})
    assert parts.where("session_id LIKE '%-10-3-2-%' AND (indirect_cost IS NOT NULL OR direct_cost IS NOT NULL)").count() == 0


def test_mart_shuffles_and_writes_no_derived_text(spark, tmp_path):
    """Ids and texts derive from narrow columns after the joins: they are neither shuffled nor written."""
    from caremart.plans import catalog
    root = _driver_tables(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    staged = []
    try:
        M.outcome_mart(catalog.care(spark, root).derived(), stage=lambda df, name: staged.append(df) or df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    files = catalog.mart(spark, root).inputFiles()
    stored = spark.read.parquet(*files).columns
    assert not {"id", "session_id", "notes", "recorded_by", "total_cost"} & set(stored), stored
    plan = staged[0]._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "Project" in line and "concat" in line.lower()], plan


def test_mart_drops_the_parts_of_the_costs_ids_after_their_join(spark, tmp_path):
    """Of the costs' rows only what their values derive from goes on through joins and stage."""
    from caremart.plans import catalog
    root = _driver_tables(spark, tmp_path)
    stored = spark.read.parquet(*catalog.mart(spark, root).inputFiles()).columns
    assert {c for c in stored if c.startswith("cost_")} - {"cost_per_session"} == {
        "cost_extendedprice", "cost_discount", "cost_tax", "cost_linenumber"}
