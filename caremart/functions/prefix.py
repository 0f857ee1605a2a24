"""Running sums per key that do not put a hot key into one task.

A window ``partitionBy(key).orderBy(t)`` sorts every row of a key in one task;
when one key holds a third of the data that task holds a third of the data.
``prefix_sums`` instead range-partitions by (key, order), sums inside each
range partition, and adds the totals of the earlier partitions of the same key
(a small per-(partition, key) table).  Range partitions hold contiguous, ordered
key ranges, so the result equals the window's running sum.  The partition ids
are written to the shared checkpoint folder once, because a re-run of the range
exchange may sample different bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
                partitions: int | None = None, suffix: str = "_cum", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``<col><suffix>`` = inclusive running sum of each column per key in ``order`` (ties broken by order).

    ``order`` must make rows unique within a key for a deterministic result.  All rows are
    shuffled and written once: ``keep`` names the columns that go along beside keys,
    order and sums (all of them, if it is not given).
    """
    keys, order, cols = list(keys), list(order), list(cols)
    if keep is not None:
        df = df.select(*dict.fromkeys([*keys, *order, *cols, *keep]))
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id())
    # The range bounds come from a sample that differs per exchange, so the partition ids are
    # written once (shared checkpoint folder) and both branches below read the same ids.
    from caremart.plans.materialize import write_stage
    r = write_stage(r, "prefix")
    # one struct of the keys: a NULL key equals itself in it, so its rows stay together and join
    r = r.withColumn("_key", F.struct(*keys))
    w_local = (Window.partitionBy("_pid", "_key").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = r.withColumns({f"_loc_{c}": F.sum(c).over(w_local) for c in cols})
    tot = r.groupBy("_pid", "_key").agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    w_off = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", "_key", *[F.coalesce(F.sum(f"_tot_{c}").over(w_off), F.lit(0)).alias(f"_off_{c}")
                                       for c in cols])
    j = r.join(off, ["_pid", "_key"])
    out = j.withColumns({f"{c}{suffix}": F.col(f"_loc_{c}") + F.col(f"_off_{c}") for c in cols})
    return out.drop("_pid", "_key", *[f"_loc_{c}" for c in cols], *[f"_off_{c}" for c in cols])


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "_idx",
              partitions: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """0-based position of each row within its key in ``order`` (skew-safe ``row_number() - 1``); see ``prefix_sums``."""
    r = prefix_sums(df.withColumn("_one", F.lit(1)), keys, order, ["_one"], partitions, keep=keep)
    return r.withColumn(out, F.col("_one_cum") - 1).drop("_one", "_one_cum")
