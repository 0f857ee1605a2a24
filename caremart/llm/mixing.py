"""Operator 1: mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target size divided by the
source's size.  Within a source the documents stand in a fixed order (large size classes first, then a hash of the
id); the running sum of expected copies plus one random offset is taken, and a document is emitted once for every
integer that its step crosses.  So a source's emitted size differs from its target by about one document of the
largest size at most, whatever the sizes.

The running sum is a rank times a rate, and the rank comes from counts of small blocks (source, size class, range
of the id's hash): block counts are pre-aggregated on the map side, their running sums are taken over a few
rows, and only the rank inside a block is a window over documents.  A source or a group of copies that holds a
third of all rows is spread over ``salts`` blocks.  No Python runs on the executors.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, sorted last;
a null id takes the hash of the text, where the rows have one; documents of one hash stand in order of id, size and text,
so reruns agree on any partitioning (the SQL twin counts null ids as hash 0); repeated rows are separate documents; sources of total size 0 have target 0; an empty
table gives an empty result; columns named like an added one are replaced.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caremart.llm.common import WORD_REGEX, n_words, read_table
from caremart.plans.materialize import write_stage

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 42
_PRIME = 2147483647


def _offset(seed: int) -> float:
    return random.Random(seed).random()


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``_skey, source_size`` -> also ``target``: shares by weight, capped at ``cap`` times the size.

    The uncapped sources share what the capped ones leave: in ascending order of cap per weight, a source is
    capped exactly when its share of the rest exceeds its cap.  The windows run over one row per source.
    """
    by_key, fill = Window.orderBy("_skey"), Window.orderBy((F.col("_cap") / F.col("_w")).asc(), "_skey")
    whole = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("_w", w).withColumns({
        "_cap": F.col("source_size") * float(cap), "_all": F.sum("source_size").over(whole)})
    t = t.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    t = t.withColumn("_full", (F.col("_all") - F.col("_before")) * F.col("_w") > F.col("_cap") * F.col("_rest"))
    level = ((F.max("_all").over(whole) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole))
             / F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole))
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_w"))
    return t.withColumn("target", target).select("_skey", "source_size", "target")


def _ordered(docs: DataFrame, size: Column, salts: int) -> DataFrame:
    """Adds the source key, size, size class (eighths of an octave), id hash and block of every document."""
    tie = F.col("_tie") if "_tie" in docs.columns else F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    docs = docs.withColumn("_tie", tie.cast("long"))
    h = F.coalesce((F.pmod(F.col("doc_id").cast("long"), F.lit(_PRIME)) * 48271) % _PRIME,
                   F.pmod(F.col("_tie"), F.lit(_PRIME)), F.lit(0))
    octave = F.length(F.bin("_size")) - 1
    cls = F.when(F.col("_size") == 0, -1).otherwise(8 * octave + F.expr(
        "cast(shiftright(8 * _size, length(bin(_size)) - 1) as int)") - 8)
    return (docs.withColumns({"_size": size.cast("long"), "_h": h, "_skey": F.coalesce(
                F.concat(F.lit("="), F.col("source")), F.lit("~"))})
            .withColumns({"_class": cls.cast("int"), "_salt": F.expr(f"cast(_h * {salts} div {_PRIME} as int)")}))


def mix_sources(docs: DataFrame, size: Column | None = None, weights: Sequence[float] = WEIGHTS, cap: float = CAP,
                seed: int = SEED, salts: int | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``size, source_size, target, copies, taken`` (copies * size).

    ``docs`` needs ``doc_id`` (integer), ``source`` and, unless ``size`` is given, ``text``.  Without the text, a column
    ``_tie`` can tell documents of equal id and size apart.
    """
    given = [c for c in docs.columns if c != "_tie"]
    spark = docs.sparkSession
    salts = salts or max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = _ordered(docs, n_words() if size is None else size, salts)
    block = ["_skey", "_class", "_salt"]
    blocks = write_stage(rows.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words")),
                         "mix-blocks")
    classes = blocks.groupBy("_skey", "_class").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"))
    targets = source_targets(classes.groupBy("_skey").agg(F.sum("_words").alias("source_size")), weights, cap)
    earlier = (Window.partitionBy("_skey").orderBy(F.desc("_class"))
               .rowsBetween(Window.unboundedPreceding, -1))
    classes = (classes.select("_skey", "_class", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_class_off"))
               .join(targets, "_skey"))
    earlier = (Window.partitionBy("_skey", "_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (blocks.select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_salt_off"))
               .join(classes, ["_skey", "_class"])
               .select(*block, (F.col("_class_off") + F.col("_salt_off")).alias("_off"),
                       F.col("source_size").alias("_source_size"), F.col("target").alias("_target")))
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("_h", "doc_id", "_size", "_tie"))
    rows = rows.withColumn("_rank", rank).join(offsets, block)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    place = F.col("_off") + F.col("_rank")
    u = F.lit(_offset(seed))
    rows = rows.withColumn("_rate", rate).withColumn(
        "_copies", (F.floor(F.col("_rate") * place + u) - F.floor(F.col("_rate") * (place - 1) + u)).cast("long"))
    added = {"size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"),
             "copies": F.col("_copies"), "taken": F.col("_copies") * F.col("_size")}
    return rows.select(*[c for c in given if c not in added], *[v.alias(k) for k, v in added.items()])


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per emitted copy of a mixed document, with its number ``copy`` from 1."""
    rows = mixed.filter(F.col("copies") > 0)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))  # ids tell the others apart
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("size"), tie.alias("_tie"))
    mixed = mix_sources(write_stage(docs, "mix-sizes"), F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS skey,
         coalesce(len(regexp_extract_all(text, '{WORD_REGEX}')), 0) AS size,
         coalesce((((doc_id % {_PRIME}) + {_PRIME}) % {_PRIME}) * 48271 % {_PRIME}, 0) AS h
  FROM documents),
o AS (
  SELECT *, CASE WHEN size = 0 THEN -1
                 ELSE 8 * (length(bin(size)) - 1) + ((8 * size) >> (length(bin(size)) - 1)::INT) - 8 END AS cls
  FROM d),
s AS (
  SELECT skey, sum(size)::BIGINT AS source_size FROM o GROUP BY skey),
w AS (
  SELECT *, [{", ".join(f"{x}.0" for x in WEIGHTS)}][((row_number() OVER (ORDER BY skey) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS w,
         (source_size * {CAP})::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
g AS (SELECT *, (total::DOUBLE - before) * w > cap * rest AS is_full FROM f),
t AS (
  SELECT skey, source_size, CASE WHEN is_full THEN cap
         ELSE (max(total) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ())::DOUBLE
              / (sum(CASE WHEN is_full THEN NULL ELSE w END) OVER ()) * w END AS target FROM g),
r AS (
  SELECT o.doc_id, o.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY o.skey ORDER BY cls DESC, h, o.doc_id) AS place
  FROM o JOIN t USING (skey)),
c AS (
  SELECT *, (floor(rate * place + {_offset(SEED)!r}::DOUBLE)
             - floor(rate * (place - 1) + {_offset(SEED)!r}::DOUBLE))::BIGINT AS copies FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""
