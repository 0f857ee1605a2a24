"""STR1-STR4: streaming import, lock-out state, daily login counts and de-duplication.

The reference has no streams; these are re-aims of its bulk import, failed-login
counter, login activity and duplicate warnings as Structured Streaming jobs.
Checkpoints live under the shared ``spark.checkpoint.dir`` so a restarted query
resumes exactly once; ``trigger(availableNow=True)`` drains what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caremart.operators import access as AC
from caremart.operators import ingest as G
from caremart.plans.materialize import stage_path, write_stage
from caremart.schemas import OUTCOMES_CSV_REQUIRED
from caremart.sources.csv import QUOTING
from caremart.sources.fs import child_names, delete, exists, rename


def stream_daily_counts(events: DataFrame, ts: str = "ts", user: str = "user_id", watermark: str = "1 day",
                        where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """STR3: events and distinct users of every closed day, exactly, with a watermark for late rows.

    Two chained stateful aggregations in append mode: events per day and user, and from
    those each day's sum and number of users.  So the state holds one row per open day
    and user, a hot user is counted on the map side, and no set of users is gathered.  A
    day is reported once, when the watermark (the latest event time less ``watermark``)
    passes its end; rows of a day that is already closed are dropped.  Null users count
    as events, not as users.  Batch twin: a count and a distinct count per day.
    """
    src = (where(events) if where else events).withWatermark(ts, watermark)
    per_user = src.groupBy(F.window(ts, "1 day").alias("w"), F.col(user).alias("_user")).agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_user.groupBy(F.window(F.window_time("w"), "1 day").alias("w")).agg(
        F.sum("_n").alias("event_count"), F.count("_user").alias("unique_users"))
    return per_day.select(F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / 86400).cast("int")).alias("day"),
                          "event_count", "unique_users")


def stream_dedupe(df: DataFrame, keys: Sequence[str], ts: str, watermark: str = "1 hour") -> DataFrame:
    """STR4: drop rows whose key was already seen within the watermark delay."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


LOCK_STATE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("account_locked", T.BooleanType()),
                           T.StructField("login_attempts", T.IntegerType()),
                           T.StructField("locked_at", T.TimestampType()),
                           T.StructField("last_login", T.TimestampType()), T.StructField("events", T.LongType()),
                           T.StructField("last_seen", T.TimestampType())])
EARLIEST = "0001-01-01 00:00:00"
BUCKETS = 64
SMALL = 500_000  # rows of a micro-batch whose keys are broadcast to the stored records


def advance_lockouts(state: DataFrame, logins: DataFrame, limit: int = 3) -> DataFrame:
    """The lock-out state after a batch of login events, from the state before it.

    An account's failed attempts so far (fewer than ``limit``) go before its new
    events, and ``access.lockouts`` does the rest, so a user with a third of a batch
    is split over tasks; locked accounts only count their events.
    """
    state = state.select(*[F.col(f.name) for f in LOCK_STATE.fields])
    early = F.lit(EARLIEST).cast("timestamp")
    seeds = (state.where(~F.col("account_locked") & (F.col("login_attempts") > 0))
             .select("user_id", early.alias("ts"), F.explode(F.sequence(
                 F.lit(-limit).cast("long"), F.col("login_attempts") - limit - 1)).alias("event_id"),
                 F.lit(True).alias("failed")))
    new = AC.lockouts(seeds.unionByName(logins.select("user_id", "ts", "event_id", "failed")), limit)
    new = new.join(logins.groupBy("user_id").agg(F.max("ts").alias("last_seen")), "user_id", "left")
    old = state.select(*[F.col(f.name).alias(f"_{f.name}") for f in LOCK_STATE.fields])
    j = old.join(new, old["_user_id"] == new["user_id"], "full_outer")
    was = F.coalesce(F.col("_account_locked"), F.lit(False))
    keep = was | F.col("user_id").isNull()
    seeded = F.when(~was, F.coalesce(F.col("_login_attempts"), F.lit(0))).otherwise(0)
    pick = lambda c: F.when(keep, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(
        F.coalesce("user_id", "_user_id").alias("user_id"), pick("account_locked"), pick("login_attempts"),
        pick("locked_at"), F.when(keep, F.col("_last_login")).otherwise(F.coalesce("last_login", "_last_login"))
        .alias("last_login"),
        (F.coalesce("_events", F.lit(0)) + F.when(F.col("user_id").isNull(), 0).otherwise(F.col("events") - seeded))
        .cast("long").alias("events"), F.greatest("_last_seen", "last_seen").alias("last_seen"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def stream_lockouts(logins: DataFrame, limit: int = 3, out_dir: str | None = None, checkpoint: str | None = None,
                    buckets: int = BUCKETS, expire: str | None = None) -> str:
    """STR2: per-user failed-login state across micro-batches; returns the folder of the states.

    The state is dealt into ``buckets`` by the user's hash.  A micro-batch reads and
    writes only the buckets of its own users, to ``epoch=<n>/bucket=<b>``; a bucket's
    state is its newest epoch (``lockout_state``).  An epoch is written aside and
    renamed, and computed from earlier epochs only, so a repeated micro-batch
    overwrites its own result; the epochs before the one it was computed from are
    deleted.  Within a micro-batch events apply in event-time order; an event that
    arrives in a later micro-batch than newer ones applies when it arrives, as a login
    service would.  With ``expire`` (an interval) unlocked accounts without events for
    that long, counted back from the micro-batch's latest event, leave a bucket when it
    is written.  All runs over a folder take the same ``buckets``.  Batch twin:
    ``access.lockouts``.
    """
    spark = logins.sparkSession
    out_dir = out_dir or stage_path(spark, "stream-lockouts")

    def advance(batch: DataFrame, epoch: int) -> None:
        # at most ``buckets`` rows come to the driver
        touched = batch.groupBy(_bucket(buckets).alias("b")).agg(F.max("ts").alias("ts")).collect()
        if not touched:
            return
        own = {r["b"] for r in touched}
        before = {b: n for b, n in newest_epochs(spark, out_dir, epoch).items() if b in own}
        state = _read_state(spark, out_dir, before)
        after = advance_lockouts(state, batch, limit)
        if expire is not None:
            since = F.lit(max(r["ts"] for r in touched)) - F.expr(f"INTERVAL {expire}")
            after = after.where(F.col("account_locked") | (F.col("last_seen") >= since))
        aside = f"{out_dir}-aside/epoch={epoch}"
        after.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket").parquet(aside)
        rename(spark, aside, f"{out_dir}/epoch={epoch}")
        _drop_superseded(spark, out_dir, before)

    _drain(logins.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint or out_dir + "-checkpoint"))
    return out_dir


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    return [int(c.partition("=")[2]) for c in child_names(spark, path) if c.startswith(f"{name}=")]


def newest_epochs(spark: SparkSession, out_dir: str, before: int | None = None) -> dict[int, int]:
    """The newest epoch (below ``before``) of every bucket that has one."""
    found: dict[int, int] = {}
    for epoch in sorted(_numbers(spark, out_dir, "epoch")):
        if before is None or epoch < before:
            found.update(dict.fromkeys(_numbers(spark, f"{out_dir}/epoch={epoch}", "bucket"), epoch))
    return found


def _read_state(spark: SparkSession, out_dir: str, epochs: dict[int, int]) -> DataFrame:
    if not epochs:
        return spark.createDataFrame([], LOCK_STATE)
    return spark.read.schema(LOCK_STATE).parquet(*[f"{out_dir}/epoch={n}/bucket={b}" for b, n in sorted(epochs.items())])


def lockout_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """The state of all users that ``stream_lockouts`` has written."""
    return _read_state(spark, out_dir, newest_epochs(spark, out_dir))


def _drop_superseded(spark: SparkSession, out_dir: str, used: dict[int, int]) -> None:
    """Delete the touched buckets of all epochs before those just read: no repeated micro-batch needs them any more."""
    for epoch in sorted(_numbers(spark, out_dir, "epoch")):
        folder = f"{out_dir}/epoch={epoch}"
        held = _numbers(spark, folder, "bucket")
        old = [b for b in held if epoch < used.get(b, -1)]
        if held and len(old) == len(held):
            delete(spark, folder)
        else:
            for b in old:
                delete(spark, f"{folder}/bucket={b}")


def _drain(writer) -> None:
    """Run a stream over what is there."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def run_to_table(stream: DataFrame, name: str, output_mode: str = "append", checkpoint: str | None = None,
                 sink: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Drain a streaming DataFrame with ``availableNow`` into a table in the shared folder; return its scan.

    Update-mode results go through ``foreachBatch`` and keep the latest row per
    batch order (the table is rewritten from the accumulated batches).
    """
    spark = stream.sparkSession
    sink = sink or stage_path(spark, f"stream-{name}")
    checkpoint = checkpoint or sink + "-checkpoint"
    if output_mode == "append":
        w = (stream.writeStream.format(fmt).option("path", sink).option("checkpointLocation", checkpoint)
             .outputMode("append"))
    else:
        def write(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(sink)
        w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(output_mode)
    _drain(w)
    return spark.read.parquet(sink)


def latest_by_key(df: DataFrame, keys: Sequence[str], order: str = "_epoch") -> DataFrame:
    """Keep the newest update per key of an update-mode sink table."""
    cols = [c for c in df.columns if c != order]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r")).select("_r.*"))


def stream_import(spark: SparkSession, in_dir: str, individuals: DataFrame, interventions: DataFrame,
                  metrics: DataFrame, stored: DataFrame, out_dir: str | None = None,
                  checkpoint: str | None = None, csv_columns: Sequence[str] = tuple(OUTCOMES_CSV_REQUIRED),
                  max_files: int = 1000, validate: bool = False) -> str:
    """STR1: import every CSV file arriving in ``in_dir`` (file ``readStream`` + ``foreachBatch``).

    Files carry the contract's columns (name optional ones in ``csv_columns``) and are
    read by RFC 4180; a file with another header fails the stream.  Each micro-batch has
    two sinks: the imported rows (the returned folder), and the rows that are not, with
    their ``outcome`` (``rejected`` or ``skipped``) and ``reasons`` (``rejects_of`` the
    folder), so that imported, skipped and rejected rows add up to the rows read.
    Rejected are rows that do not convert or whose names are unknown; with ``validate``
    names must be active and scores within their metric's scale, as in the validation of
    a file.  ``skip_duplicates`` sees the stored records and the keys of earlier
    micro-batches, of which only the months that the batch touches are read; the keys of
    a batch of at most ``SMALL`` rows go to them, a larger batch meets them in a shuffle.
    The names' ids are derived once for all micro-batches of a run.  A repeated
    micro-batch overwrites its own rows in both sinks.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in csv_columns])
    out_dir = out_dir or stage_path(spark, "stream-import")
    keys_dir, judged_dir = out_dir + "-keys", out_dir + "-judged"
    src = (spark.readStream.schema(schema).options(**QUOTING).option("multiLine", True).option("enforceSchema", False)
           .option("maxFilesPerTrigger", max_files).csv(in_dir)
           .select("*", F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_block")))
    month = F.date_format(F.trunc("session_date", "month"), "yyyy-MM")
    ids = {c: write_stage(d, "stream-names") for c, d in
           G.name_ids(individuals, interventions, metrics, validate, validate).items()}

    def import_batch(batch: DataFrame, epoch: int) -> None:
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("string")
        b = batch.withColumn("row_num", F.concat_ws("#", "_file", F.lpad(F.col("_block").cast("string"), 20, "0"),
                                                    F.lpad(row, 12, "0")))
        # judged once: both sinks read the same written rows
        G.judged_by(b, ids, validate).write.mode("overwrite").parquet(judged_dir)
        judged = spark.read.parquet(judged_dir)
        accepted = judged.where(F.size("reasons") == 0)
        days = accepted.select(F.col("session_day").alias("session_date"))
        months = [r["m"] for r in days.select(month.alias("m")).distinct().collect()]  # bounded by the calendar
        cols = ["individual_id", "intervention_id", "session_date"]
        existing = stored.select(*cols).where(month.isin(months))
        if exists(spark, keys_dir):
            done = spark.read.parquet(keys_dir).where((F.col("epoch") < epoch) & F.col("month").isin(months))
            existing = existing.unionByName(done.select(*cols))
        if accepted.count() <= SMALL:
            keys = accepted.select("individual_id", "intervention_id", F.col("session_day").alias("session_date"))
            existing = existing.join(F.broadcast(keys.distinct()), cols, "left_semi").distinct()
        G.new_rows(accepted, existing=existing, batch_id="stream").write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
        imported = spark.read.parquet(f"{out_dir}/epoch={epoch}")
        skipped = (accepted.join(imported.select("row_num"), "row_num", "left_anti")
                   .withColumn("reasons", F.array(F.lit("already imported"))))
        why = ["row_num", *csv_columns, "reasons"]
        rejects = (judged.where(F.size("reasons") > 0).select(F.lit("rejected").alias("outcome"), *why)
                   .unionByName(skipped.select(F.lit("skipped").alias("outcome"), *why)))
        rejects.write.mode("overwrite").parquet(f"{rejects_of(out_dir)}/epoch={epoch}")
        imported.select(*cols, month.alias("month")).write.mode("overwrite").partitionBy("month").parquet(
            f"{keys_dir}/epoch={epoch}")

    _drain(src.writeStream.foreachBatch(import_batch).option("checkpointLocation", checkpoint or out_dir + "-checkpoint"))
    delete(spark, judged_dir)
    return out_dir


def rejects_of(out_dir: str) -> str:
    """The folder of the rows that a ``stream_import`` did not import."""
    return out_dir + "-rejects"
