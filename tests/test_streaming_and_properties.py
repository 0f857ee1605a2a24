"""Streaming jobs against their batch twins; properties of mart-level operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caremart.operators import aggregates as A
from caremart.operators import ingest as G

SF = "/root/testdata/sf0.001"


def test_stream_daily_counts_and_dedupe_match_batch(spark, tmp_path):
    from caremart.streaming import jobs as SJ
    base = dt.datetime(2024, 1, 1)
    rows = [(i, i % 5, base + dt.timedelta(hours=7 * i), "click" if i % 3 else "error") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string")
    src = str(tmp_path / "events")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = SJ.run_to_table(SJ.stream_daily_counts(stream), "t-daily", sink=str(tmp_path / "d"),
                          checkpoint=str(tmp_path / "dck"))
    got = {r["day"]: (r["event_count"], r["unique_users"]) for r in out.collect()}
    closed = (max(t for _, _, t, _ in rows) - dt.timedelta(days=1)).date()
    exp = {r["d"]: (r["c"], r["u"]) for r in df.groupBy(F.to_date("ts").alias("d")).agg(
        F.count("*").alias("c"), F.count_distinct("user_id").alias("u")).collect() if r["d"] < closed}
    assert got == exp and len(exp) > 10
    stream2 = spark.readStream.schema(df.schema).parquet(src)
    dd = SJ.run_to_table(SJ.stream_dedupe(stream2, ["user_id", "event_type"], "ts", "30 days"), "t-dedupe",
                         sink=str(tmp_path / "u"), checkpoint=str(tmp_path / "uck"))
    keys = sorted((r["user_id"], r["event_type"]) for r in dd.collect())
    assert keys == sorted({(u, t) for _, u, _, t in rows})


def test_stream_import_matches_batch(spark, tmp_path):
    from caremart.streaming import jobs as SJ
    ind = spark.createDataFrame([("i1", "A1", True)], "id string, anonymous_id string, active boolean")
    itv = spark.createDataFrame([("t1", "Art", True)], "id string, name string, active boolean")
    met = spark.createDataFrame([("m1", "Mood", 0.0, 10.0, True)], "id string, name string, scale_min double, "
                                "scale_max double, active boolean")
    stored = spark.createDataFrame([("i1", "t1", dt.date(2020, 1, 3))], "individual_id string, "
                                   "intervention_id string, session_date date")
    cols = ("individual_anonymous_id string, intervention_name string, metric_name string, score string, "
            "session_date string")
    days = ["2020-01-01", "2020-01-01", "2020-01-03", "2020-01-04"]
    batch = spark.createDataFrame([("A1", "Art", "Mood", str(5 + i), d) for i, d in enumerate(days)], cols)
    in_dir, out_dir = str(tmp_path / "csv"), str(tmp_path / "out")
    batch.coalesce(1).write.option("header", True).csv(in_dir)
    out = SJ.stream_import(spark, in_dir, ind, itv, met, stored, out_dir=out_dir)
    got = sorted((str(r["session_date"]), r["score"]) for r in spark.read.parquet(out).collect())
    assert got == [("2020-01-01", 5.0), ("2020-01-04", 8.0)]
    # a later file: a key of the first micro-batch, and a new one
    later = spark.createDataFrame([("A1", "Art", "Mood", "1", "2020-01-04"), ("A1", "Art", "Mood", "2", "2020-02-01")], cols)
    later.coalesce(1).write.mode("append").option("header", True).csv(in_dir)
    SJ.stream_import(spark, in_dir, ind, itv, met, stored, out_dir=out_dir)
    rows = spark.read.parquet(out).collect()
    assert sorted(r["score"] for r in rows) == [2.0, 5.0, 8.0] and len({r["id"] for r in rows}) == 3


def test_stream_import_refuses_another_header(spark, tmp_path):
    from caremart.streaming import jobs as SJ
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text("who,what,which,score,session_date\nA1,Art,Mood,1,2020-01-01\n")
    dim = spark.createDataFrame([("i", "n", "n", True)], "id string, anonymous_id string, name string, active boolean")
    met = dim.selectExpr("id", "name", "0.0D AS scale_min", "1.0D AS scale_max", "active")
    stored = spark.createDataFrame([], "individual_id string, intervention_id string, session_date date")
    with pytest.raises(Exception):
        SJ.stream_import(spark, str(tmp_path / "bad"), dim, dim, met, stored, out_dir=str(tmp_path / "o"))


def test_stream_daily_counts_late_rows_and_restart(spark, tmp_path):
    """Three runs of one stream; a row of a closed day is dropped, one of an open day still counts."""
    from caremart.streaming import jobs as SJ
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    runs = [[(1, 7, at(1, 3)), (2, 7, at(1, 4)), (3, 8, at(1, 23)), (4, None, at(1, 5)), (5, 9, at(2, 1)), (6, 7, at(4, 2))],
            [(7, 5, at(1, 6)), (8, 6, at(4, 1)), (9, 7, at(4, 23)), (10, 7, at(6, 1))],  # event 7 is late: day 1 is closed
            [(11, 7, at(9, 0))]]
    src, got = str(tmp_path / "in"), {}
    cols = "event_id long, user_id long, ts timestamp"
    for rows in runs:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(src)
        out = SJ.run_to_table(SJ.stream_daily_counts(spark.readStream.schema(cols).parquet(src)), "late",
                              sink=str(tmp_path / "d"), checkpoint=str(tmp_path / "ck"))
        got = {str(r["day"])[-2:]: (r["event_count"], r["unique_users"]) for r in out.collect()}
        assert len(got) == out.count()  # no day is reported twice
    assert got == {"01": (4, 2), "02": (1, 1), "04": (3, 2), "06": (1, 1)}


def test_stream_import_accounts_for_every_row(spark, tmp_path):
    from caremart.streaming import jobs as SJ
    ind = spark.createDataFrame([("i1", "A1", True), ("i2", "A2", False)], "id string, anonymous_id string, active boolean")
    itv = spark.createDataFrame([("t1", "Art", True)], "id string, name string, active boolean")
    met = spark.createDataFrame([("m1", "Mood", 0.0, 10.0, True)], "id string, name string, scale_min double, "
                                "scale_max double, active boolean")
    stored = spark.createDataFrame([("i1", "t1", dt.date(2020, 1, 3))], "individual_id string, "
                                   "intervention_id string, session_date date")
    (tmp_path / "csv").mkdir()
    head = "individual_anonymous_id,intervention_name,metric_name,score,session_date,notes\n"
    files = {"a.csv": 'A1,Art,Mood,5,2020-01-01,"said ""hi"", ok"\nA1,Art,Mood,6,2020-01-01,again\n'
                      'A1,Art,Mood,7,2020-01-03,stored\nA2,Art,Mood,7,2020-01-04,inactive\n',
             "b.csv": 'A1,Art,Mood,11,2020-01-05,high\nA1,Art,Mood,n/a,soon,"two\nlines"\nA1,Art,Mood,,,\nB,Cut,Joy,1,2020-01-06,\n'
                      'A1,Art,Mood,8,2020-02-01,\n'}
    columns = ["individual_anonymous_id", "intervention_name", "metric_name", "score", "session_date", "notes"]
    out = str(tmp_path / "out")
    for name, text in files.items():
        (tmp_path / "csv" / name).write_text(head + text)
        SJ.stream_import(spark, str(tmp_path / "csv"), ind, itv, met, stored, out_dir=out, csv_columns=columns, validate=True)
    read = lambda: (sorted((r["score"], r["notes"]) for r in spark.read.parquet(out).collect()),
                    sorted((r["outcome"], r["notes"], "; ".join(r["reasons"])) for r in
                           spark.read.parquet(SJ.rejects_of(out)).na.fill("").collect()))
    rows, rejects = read()
    assert rows == [(5.0, 'said "hi", ok'), (8.0, "")]
    assert rejects == [
        ("rejected", "", "score is missing; date is missing"),
        ("rejected", "", "unknown individual; unknown intervention; unknown metric"),
        ("rejected", "high", "score is out of range"), ("rejected", "inactive", "unknown individual"),
        ("rejected", "two\nlines", "score does not convert; date does not convert"),
        ("skipped", "again", "already imported"), ("skipped", "stored", "already imported")]
    # the last micro-batch again, as after a crash before its commit: nothing changes
    (tmp_path / "out-checkpoint" / "commits" / "1").unlink()
    (tmp_path / "out-checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    SJ.stream_import(spark, str(tmp_path / "csv"), ind, itv, met, stored, out_dir=out, csv_columns=columns, validate=True)
    assert read() == (rows, rejects)


def brute_lockouts(events, limit=3):
    out = {}
    for user, ts, _, failed in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        attempts, locked_at, last, n = out.get(user, (0, None, None, 0))
        if locked_at is None:
            if failed:
                attempts += 1
                locked_at = ts if attempts >= limit else None
            else:
                attempts, last = 0, ts
        out[user] = (attempts, locked_at, last, n + 1)
    return out


def test_lockouts_with_a_hot_user_and_in_batches(spark):
    import random
    from caremart.operators import access as AC
    from caremart.streaming import jobs as SJ
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    events = [(1 if rnd.random() < 0.4 else rnd.randrange(2, 40), base + dt.timedelta(minutes=rnd.randrange(3000)), i,
               rnd.random() < 0.35) for i in range(1500)]
    cols = "user_id long, ts timestamp, event_id long, failed boolean"
    full = spark.createDataFrame(events, cols).repartition(6)
    read = lambda df: {r["user_id"]: (r["login_attempts"], r["locked_at"], r["last_login"], r["events"])
                       for r in df.collect()}
    want = brute_lockouts(events)
    assert read(AC.lockouts(full)) == want
    cut = base + dt.timedelta(minutes=900)
    state = SJ.advance_lockouts(spark.createDataFrame([], SJ.LOCK_STATE), full.where(F.col("ts") < F.lit(cut)))
    assert read(SJ.advance_lockouts(state, full.where(F.col("ts") >= F.lit(cut)))) == want


def test_stream_lockouts_write_touched_buckets_only(spark, tmp_path):
    import os
    from caremart.streaming import jobs as SJ
    base = dt.datetime(2024, 1, 1)
    runs = [[(u, base + dt.timedelta(days=k, minutes=u + 40 * i), 1000 * k + 10 * u + i, (u + i + k) % 3 > 0)
             for u in range(1, 40) for i in range(3)] for k in range(3)]
    runs += [[(5, base + dt.timedelta(days=10 + k), 9000 + k, k % 2 == 0)] for k in range(3)]  # three runs of one user
    cols = "user_id long, ts timestamp, event_id long, failed boolean"
    src, out, written = str(tmp_path / "in"), str(tmp_path / "out"), []
    for rows in runs:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(src)
        SJ.stream_lockouts(spark.readStream.schema(cols).parquet(src), out_dir=out, buckets=8)
        newest = SJ.newest_epochs(spark, out)
        written.append(sum(n == max(newest.values()) for n in newest.values()))
        held = [b for e in os.listdir(out) for b in os.listdir(f"{out}/{e}") if b.startswith("bucket=")]
        assert max(map(held.count, held)) <= 2  # the state and the one it was computed from; older epochs are gone
    assert written == [8, 8, 8, 1, 1, 1]
    got = {r["user_id"]: (r["login_attempts"], r["locked_at"], r["last_login"], r["events"])
           for r in SJ.lockout_state(spark, out).collect()}
    assert got == brute_lockouts([e for rows in runs for e in rows])
    # the last run again, as after a crash before its commit
    last = max(map(int, (f for f in os.listdir(f"{out}-checkpoint/commits") if f.isdigit())))
    os.unlink(f"{out}-checkpoint/commits/{last}")
    if os.path.exists(f"{out}-checkpoint/commits/.{last}.crc"):
        os.unlink(f"{out}-checkpoint/commits/.{last}.crc")
    SJ.stream_lockouts(spark.readStream.schema(cols).parquet(src), out_dir=out, buckets=8)
    assert got == {r["user_id"]: (r["login_attempts"], r["locked_at"], r["last_login"], r["events"])
                   for r in SJ.lockout_state(spark, out).collect()}


def test_stream_lockouts_expire(spark, tmp_path):
    from caremart.streaming import jobs as SJ
    base = dt.datetime(2024, 1, 1)
    old = [(1, base, 1, True), (2, base, 2, True), (2, base, 3, True), (2, base, 4, True), (3, base, 5, False)]
    new = [(4, base + dt.timedelta(days=40), 6, True), (3, base + dt.timedelta(days=39), 7, True)]
    cols = "user_id long, ts timestamp, event_id long, failed boolean"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (old, new):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(src)
        SJ.stream_lockouts(spark.readStream.schema(cols).parquet(src), out_dir=out, buckets=1, expire="30 days")
    got = {r["user_id"]: (r["account_locked"], r["login_attempts"]) for r in SJ.lockout_state(spark, out).collect()}
    assert got == {2: (True, 3), 3: (False, 1), 4: (False, 1)}  # 1 has expired; a locked account never does


@pytest.fixture(scope="module")
def small_mart(spark):
    from caremart.plans.catalog import mart
    return mart(spark, SF)


def test_mart_properties(small_mart):
    r = small_mart.agg(F.min("normalized_score").alias("lo"), F.max("normalized_score").alias("hi"),
                       F.count_if(F.col("normalized_score").isNull()).alias("nulls")).collect()[0]
    assert 0.0 <= r["lo"] <= r["hi"] <= 10.0 and r["nulls"] == 0
    shares = A.cost_share(small_mart).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)
    q = A.effectiveness_quadrants(small_mart)
    assert q.count() == small_mart.select("intervention_name").distinct().count()
    assert {x["quadrant"] for x in q.collect()} <= set(A.QUADRANTS)


def test_one_individual_with_a_third_of_the_rows(spark, small_mart):
    """Individual reports aggregate before the shuffle, so a hot individual is not one task's rows."""
    from caremart.operators import individuals as I
    hot = small_mart.withColumn("anonymous_id", F.when(F.xxhash64("id") % 3 == 0, "hot").otherwise(F.col("anonymous_id")))
    got = {r["anonymous_id"]: r["total_sessions"] for r in I.individual_summary(hot).collect()}
    assert got["hot"] == hot.where("anonymous_id = 'hot'").count() > 0.25 * hot.count()
    plan = I.individual_effectiveness(small_mart)._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and "Exchange hashpartitioning(anonymous_id" in plan
