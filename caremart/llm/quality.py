"""Operator 9: quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

The model predicts the characters of a word (order ``ORDER``, padded at the word's start, with a sign at its end), so
it needs no vocabulary and serves all languages of the trusted text at once.

Counting: every task counts the n-grams of its words and hands on one row for each distinct n-gram; the rows are
summed by a shuffle on the n-gram.  Lower orders are Kneser-Ney continuation counts of the next higher one.
Discounts come from the counts of counts.  The probabilities are joined order by order on the shortened n-gram, both
sides sharded by its hash.  All of this grows with the trusted text and stays in Spark tables.

Scoring: the finished table is sharded by the last two characters of the context, about ``SHARD`` rows each, plus the
orders 1 and 2, which every shard holds (at most the square of the number of distinct characters).  Shard after
shard is joined to the documents by a broadcast in an Arrow map, which adds the log-probabilities of the characters that
the shard knows the context of; words that recur in a task are scored once.  The documents are not shuffled.

Decision: a document is rejected when its perplexity is above its language's threshold, the ``QUANTILE`` of the
perplexities of trusted documents that the model was not trained on (a quarter of them, by crc32 of the id), times
``MARGIN``.  A language with fewer than ``LEAST`` such documents takes the threshold of all languages together.

Defined cases: a text without words has a null perplexity and is kept; a null language is one of its own; a null id or
a null label is not trusted; a document with several labels is trusted if one of them is 1; without trusted text
nothing is rejected; repeated rows are scored separately; an empty table gives an empty result; columns of the
documents that are named like an added one are replaced.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caremart.llm.common import read_table
from caremart.plans.materialize import write_stage

ORDER = 5
SHARD = 1_000_000
QUANTILE, MARGIN, LEAST = 0.99, 1.15, 20
START, STOP = "\x02", "\x03"
COUNTED = 500_000  # distinct words, or n-grams, that a task holds before it hands them on


def ngram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, c``: how often every padded n-gram occurs inside the words of ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: Counter = Counter()

        def spell() -> None:
            for w, n in words.items():
                s = START * (order - 1) + w + STOP
                for i in range(len(w) + 1):
                    grams[s[i:i + order]] += n
            words.clear()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()),
                                              pa.array(list(grams.values()), pa.int64())], names=["gram", "c"])
            grams.clear()
            return out

        for batch in batches:
            for value in batch.column(0):
                words.update((value.as_py() or "").split())
                if len(words) > COUNTED:
                    spell()
                if len(grams) > COUNTED:
                    yield rows()
        spell()
        yield rows()

    return texts.select("text").mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and 3 or more; 0.5, 1 and 1.5 where counts are missing."""
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), raw))


def train(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """The model as a written table ``order, gram, logp, logb``.

    ``logp``: log-probability of the n-gram's last character after the others.  ``logb``: log-weight of the shorter
    context after this n-gram as context (null where it never is one).  The row of order 0 holds the log-probability
    of an unseen character.
    """
    counts = write_stage(ngram_counts(texts, order), "ngrams").withColumn("order", F.lit(order))
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        shorter = F.substring("gram", 2, k)
        tables[k] = write_stage(tables[k + 1].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("c"))
                                .withColumn("order", F.lit(k)), f"ngrams-{k}")
    every = tables[order]
    for k in range(order - 1, 0, -1):
        every = every.unionByName(tables[k])
    found = {r["order"]: r for r in every.groupBy("order").agg(
        *[F.sum(F.when(F.col("c") == n, 1).otherwise(0)).alias(f"n{n}") for n in (1, 2, 3, 4)],
        F.count(F.lit(1)).alias("kinds")).collect()}
    lower = None
    backoffs = {}
    for k in range(1, order + 1):
        r = found.get(k)
        d = _discounts(*(r[f"n{n}"] for n in (1, 2, 3, 4))) if r else (0.5, 1.0, 1.5)
        kinds = found[1]["kinds"] + 1 if found else 1
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = tables[k].select("gram", "c", discount.alias("_d"), F.expr(f"substring(gram, 1, {k - 1})").alias("_ctx"))
        context = rows.groupBy("_ctx").agg(F.sum("c").alias("_total"), F.sum("_d").alias("_left"))
        rows = rows.join(context, "_ctx")
        if lower is None:
            below = F.lit(1.0 / kinds)
            unseen = context.select((F.col("_left") / F.col("_total") / kinds).alias("p"))
        else:
            rows = rows.withColumn("_short", F.substring("gram", 2, k - 1)).join(
                lower.select(F.col("gram").alias("_short"), F.col("p").alias("_p")), "_short")
            below = F.col("_p")
            backoffs[k - 1] = context.select(F.col("_ctx").alias("gram"), (F.col("_left") / F.col("_total")).alias("b"))
        lower = write_stage(rows.select("gram", ((F.col("c") - F.col("_d")) / F.col("_total")
                                                 + F.col("_left") / F.col("_total") * below).alias("p")), f"kn-{k}")
        tables[k] = lower
    out = unseen.select(F.lit(0).alias("order"), F.lit("").alias("gram"), F.log("p").alias("logp"),
                        F.lit(None).cast("double").alias("logb"))
    for k in range(1, order + 1):
        rows = tables[k]
        # a context of pads alone is followed by characters but never follows one, so it has no row of its own
        rows = rows.join(backoffs[k], "gram", "full") if k < order else rows.withColumn("b", F.lit(None).cast("double"))
        out = out.unionByName(rows.select(F.lit(k).alias("order"), "gram", F.log("p").alias("logp"),
                                          F.log("b").alias("logb")))
    return write_stage(out, "kn-model")


class Shard:
    """Part of the model: the n-grams of some contexts, and all of orders 1 and 2."""

    def __init__(self, rows: list, order: int, shards: int, own: int):
        self.order, self.shards, self.own = order, shards, own
        self.logp = {r[0]: r[1] for r in rows if r[0] and r[1] is not None}
        self.logb = {r[0]: r[2] for r in rows if r[0] and r[2] is not None}
        self.unseen = next((r[1] for r in rows if not r[0]), 0.0)

    def word(self, w: str) -> tuple[float, int]:
        """Sum of the log-probabilities of the word's characters whose context the shard holds, and their number."""
        logp, logb, pad = self.logp, self.logb, self.order - 1
        s = START * pad + w + STOP
        total, n = 0.0, 0
        for i in range(len(w) + 1):
            gram = s[i:i + pad + 1]
            if self.shards > 1 and shard_of(gram[:-1], self.shards) != self.own:
                continue
            n += 1
            while True:
                p = logp.get(gram)
                if p is not None:
                    total += p
                    break
                total += logb.get(gram[:-1], 0.0)
                gram = gram[1:]
                if not gram:
                    total += self.unseen
                    break
        return total, n


def shard_of(context: str, shards: int) -> int:
    return sum(ord(c) * f for c, f in zip(context[-2:], (31, 7))) % shards


def _shard_column(shards: int):
    """``shard_of`` the context of a row's n-gram (for ``logp``) and of the n-gram as a context (for ``logb``)."""
    def code(at):
        return F.expr(f"(ascii(substring(gram, {at}, 1)) * 31 + ascii(substring(gram, {at + 1}, 1)) * 7) % {shards}")
    return code(-3), code(-2)


class PackedShard:
    """A shard as the Arrow table that the driver passes on; a Python worker builds its maps once, when it first needs them."""

    def __init__(self, table: pa.Table, order: int, shards: int, own: int):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.packed, self.settings, self.built = sink.getvalue().to_pybytes(), (order, shards, own), None

    def unpacked(self) -> Shard:
        if self.built is None:
            table = pa.ipc.open_stream(self.packed).read_all()
            self.built = Shard(list(zip(*(table.column(c).to_pylist() for c in range(3)))), *self.settings)
        return self.built

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}


def packed_shards(model: DataFrame, order: int = ORDER, size: int = SHARD) -> Iterator[PackedShard]:
    """The model in shards of about ``size`` rows, which pass through the driver one after the other, as Arrow bytes."""
    total = model.count()
    shards = max(1, -(-total // size))
    logp_at, logb_at = _shard_column(shards)
    for k in range(shards):
        part = model.filter((F.col("order") <= 2) | (logp_at == k) | (logb_at == k)) if shards > 1 else model
        yield PackedShard(part.select("gram", "logp", "logb").toArrow(), order, shards, k)


def shards_of_model(model: DataFrame, order: int = ORDER, size: int = SHARD) -> list[Shard]:
    """The shards with their maps, all of them on the driver; scoring takes ``shared_model``."""
    return [shard.unpacked() for shard in packed_shards(model, order, size)]


def shared_model(model: DataFrame, order: int = ORDER, size: int = SHARD) -> list:
    """A broadcast for each shard of the model; several scorings take the same ones."""
    sc = model.sparkSession.sparkContext
    return [sc.broadcast(shard) for shard in packed_shards(model, order, size)]


def perplexity(docs: DataFrame, model: DataFrame | list, order: int = ORDER, size: int = SHARD) -> DataFrame:
    """All columns of ``docs`` plus ``perplexity`` (of a character, the word's end included).

    ``model`` is the written table or its broadcasts (``shared_model``).
    """
    docs = docs.select(*[c for c in docs.columns if c != "perplexity"])
    at = docs.columns.index("text")
    rows = docs.withColumns({"_ll": F.lit(0.0), "_n": F.lit(0).cast("long")})
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    for shared in model if isinstance(model, list) else shared_model(model, order, size):
        rows = rows.mapInArrow(_scorer(shared, at), schema)
    ppl = F.when(F.col("_n") > 0, F.exp(-F.col("_ll") / F.col("_n")))
    return rows.select(*docs.columns, ppl.alias("perplexity"))


def _scorer(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value.unpacked()
        known: dict[str, tuple[float, int]] = {}
        for batch in batches:
            ll, n = [], []
            for value in batch.column(at):
                total, chars = 0.0, 0
                for w in (value.as_py() or "").split():
                    v = known.get(w)
                    if v is None:
                        if len(known) > COUNTED:
                            known.clear()
                        v = known[w] = shard.word(w)
                    total += v[0]
                    chars += v[1]
                ll.append(total)
                n.append(chars)
            sums = [batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False) + np.array(ll, float),
                    batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) + np.array(n, np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sums[0]), pa.array(sums[1])],
                                             schema=batch.schema)

    return run


def _held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 3


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_trusted")).distinct()


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN,
               least: int = LEAST) -> DataFrame:
    """``_lang, threshold``: one row for each language, and the row of ``null`` key ``~`` for all together."""
    held = (scored.filter("perplexity IS NOT NULL").select("doc_id", "lang", "perplexity")
            .join(trusted_ids(labels), F.col("doc_id") == F.col("_trusted")).filter(_held_out(F.col("doc_id"))))
    rows = held.withColumn("_lang", F.explode(F.array(_lang(), F.lit("~"))))
    return (rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"), (F.percentile_approx(
        "perplexity", quantile, 10_000) * margin).alias("threshold"))
        .filter((F.col("_n") >= least) | (F.col("_lang") == "~")).select("_lang", "threshold"))


def _lang():
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))


ADDED = ("perplexity", "threshold", "keep", "_ll", "_n")


def _trained(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The model of the trusted documents' texts.

    Labels grow with the documents, so the two always meet in a shuffle join.
    """
    trusted = trusted_ids(labels).filter(~_held_out(F.col("_trusted"))).hint("merge")
    return train(docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_trusted")).select("text"))


def _judged(scored: DataFrame, limits: list) -> DataFrame:
    """Adds each row's threshold and decision; ``limits`` is one row for each language."""
    table = F.create_map(*[F.lit(x) for r in limits for x in (r["_lang"], float(r["threshold"]))]) if limits else None
    limit = F.coalesce(table[_lang()], table[F.lit("~")]) if limits else F.lit(None).cast("double")
    return scored.withColumn("threshold", limit).withColumn(
        "keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def judge(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """All columns of ``docs`` plus ``perplexity, threshold, keep``; the texts are scored where they stand."""
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    model = shared_model(_trained(docs, labels))
    held = trusted_ids(labels).filter(_held_out(F.col("_trusted")))
    sample = docs.select("doc_id", "lang", "text").filter(_held_out(F.col("doc_id"))).join(
        held.hint("merge"), F.col("doc_id") == F.col("_trusted"), "left_semi")
    limits = thresholds(write_stage(perplexity(sample, model).drop("text"), "held-out"), labels, **settings).collect()
    return _judged(perplexity(docs, model), limits)


def judged_ids(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``doc_id, lang, perplexity, threshold, keep`` of every row, with every text scored once."""
    slim = docs.select("doc_id", "lang", "text")
    scored = write_stage(perplexity(slim, _trained(slim, labels)).drop("text"), "perplexity")
    return _judged(scored, thresholds(scored, labels, **settings).collect())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_ids(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
