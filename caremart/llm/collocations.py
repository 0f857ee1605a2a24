"""Operator 13: phrase collocations by marginalising counts of the longest windows.

Texts are split into pieces, pieces into words; phrases have 2 to ``LONGEST`` words inside a piece.  Counts of all
lengths come from one kind of row: for each position the window of its word and the next four, padded where a phrase
cannot go on.  Windows are counted whole (inside the tasks, then by a shuffle), and Spark's ROLLUP over the five word
columns sums them to the counts of every shorter prefix.  No n-gram of another length is ever emitted.

A window goes on as long as its phrase can still reach ``least`` occurrences (the count of a phrase is at most that of
its words and of the pairs and triples in it), which keeps the windows few:

1. words are counted, as strings, in each language: these are the counts of single words and the sizes ``n``;
2. pairs and triples of neighbouring frequent words are counted by a 64-bit hash;
3. windows end before a word that is not frequent, and where a pair or triple would not be.

The frequent words, and the pairs and triples, reach the tasks as two bitmaps of ``BITS`` bits each, 4 MB whatever the
corpus.  A false positive of a bitmap, or two triples of one hash, only leave a longer window: every count that is kept
is exact, since a phrase with ``least`` occurrences is never cut.

Scores join the counts of a phrase's two parts, for each cut, as rows (nothing is broadcast by hand); products are
decimals of up to 38 digits.  Languages may be hot: all counts are summed in the tasks first, and the ranking keeps at
most ``top`` rows of a language from each task.

Defined cases: a null text is empty; a null language is ``und``, together with the language of that name; repeated rows
are counted as often as they stand; texts without words count nothing; ties go by the order of the contract, so no
two rows of a language share a rank; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caremart.llm.common import joined, mix64, read_table, span_hashes, text_chunks, word_spans
from caremart.plans.materialize import write_stage

LONGEST = 5
LEAST = 100
TOP = 2000
BITS = 1 << 25
COUNTED = 300_000  # distinct words, or windows, that a task holds before it hands them on
HASHES = 4_000_000  # hashes of pairs and triples that a task holds before it counts them

# lower-case A-Z, a line break for every end of a piece, a space for a tab
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\x09", bytes(range(97, 123)) + b"\n" * 10 + b" ")
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, 0x0A]] = True
WORDS = [f"w{k + 1}" for k in range(LONGEST)]


def plain(text: str | None) -> bytes:
    """The text's UTF-8 bytes: words between spaces, pieces between line breaks."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN)


def _rows(counted: Counter, columns: int) -> pa.RecordBatch:
    """A record batch of the keys' strings and the counts; clears the counter."""
    keys = list(zip(*counted)) or [()] * columns
    out = pa.RecordBatch.from_arrays(
        [*[pa.array([w.decode("utf-8", "surrogatepass") if isinstance(w, bytes) else w for w in k], pa.string())
           for k in keys], pa.array(list(counted.values()), pa.int64())],
        names=["lang", *WORDS[:columns - 1], "c"])
    counted.clear()
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, w1, c``: the occurrences of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                yield _rows(Counter({(lang, w): c for w, c in words.items()}), 2)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(plain(text).split())
            if sum(map(len, held.values())) > COUNTED:
                yield from hand_on()
        yield from hand_on()

    return docs.mapInArrow(run, "lang string, w1 string, c long").groupBy("lang", "w1").agg(F.sum("c").alias("c"))


def _hashes(texts: list[str | None], langs: list[str]) -> Iterator[tuple]:
    """For runs of texts: their plain bytes, the words' starts, ends and hashes with their language, and the pieces."""
    seed = {lang: int.from_bytes(lang.encode("utf-8", "surrogatepass")[-7:], "little") * 0x9E3779B97F4A7C15 % (1 << 64)
            for lang in set(langs)}
    for first, chunk in text_chunks(texts):
        buf, starts = joined([b.translate(PLAIN) for b in chunk])
        ws, we = word_spans(buf, BREAKS)
        if not len(ws):
            continue
        doc = np.searchsorted(starts, ws, "right") - 1 + first
        seeds = np.array([seed[lang] for lang in langs[first:first + len(chunk)]], np.uint64)
        yield (buf, ws, we, mix64(span_hashes(buf, ws, we) + seeds[doc - first]), np.cumsum(buf == 0x0A)[ws], doc)


def _pairs(words: np.ndarray, known: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, the hashes of the pair and of the triple that it begins, and whether these are of known words."""
    pair = mix64(words[:-1] * np.uint64(3) + words[1:])
    is_pair = (piece[:-1] == piece[1:]) & known[:-1] & known[1:]
    return pair, is_pair, mix64(pair[:-1] * np.uint64(5) + words[2:]), is_pair[:-1] & is_pair[1:]


def _bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of a column ``h``: at most ``BITS / 64`` numbers come to the driver, however many hashes there are."""
    at = F.col("h").bitwiseAND(F.lit(BITS - 1))
    rows = (hashes.groupBy(F.shiftright(at, 6).alias("k"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("v")).toArrow())
    out = np.zeros(BITS // 64, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return out


def _frequent_words(words: DataFrame, least: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [x[3] for x in _hashes(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            h = np.concatenate(h) if h else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return _bitmap(words.filter(F.col("c") >= least).select("lang", "w1").mapInArrow(run, "h long"))


def _frequent_runs(docs: DataFrame, frequent, least: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def count() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held) >> np.uint64(8), return_counts=True)
            held.clear()
            full, rest = np.repeat(h, c // 255), c % 255
            packed = np.concatenate((full << np.uint64(8) | np.uint64(255),
                                     (h << np.uint64(8) | rest.astype(np.uint64))[rest > 0]))
            return pa.RecordBatch.from_arrays([pa.array(packed.view(np.int64))], names=["hc"])

        for batch in batches:
            for _, _, _, words, piece, _ in _hashes(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                pair, is_pair, triple, is_triple = _pairs(words, _bit(frequent.value, words), piece)
                held += [pair[is_pair], triple[is_triple]]
                size += len(held[-1]) + len(held[-2])
            if size > HASHES:
                yield count()
                size = 0
        if size:
            yield count()

    # one number holds 56 bits of the hash and a count up to 255; counted in the tasks already, rows go to their hash as
    # they are
    h, c = F.shiftrightunsigned("hc", 8), F.col("hc").bitwiseAND(F.lit(255))
    counts = docs.mapInArrow(run, "hc long").repartition(h).groupBy(h.alias("h")).agg(F.sum(c).alias("c"))
    return _bitmap(counts.filter(F.col("c") >= least).select("h"))


def _windows(docs: DataFrame, frequent, pairs) -> DataFrame:
    """``lang, w1..w5, c``: the longest windows of two words or more, padded with nulls, counted inside each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for buf, ws, we, words, piece, doc in _hashes(batch.column(1).to_pylist(), langs):
                pair, is_pair, triple, is_triple = _pairs(words, _bit(frequent.value, words), piece)
                is_pair[is_pair] = _bit(pairs.value, pair[is_pair] >> np.uint64(8))
                is_triple[is_triple] = _bit(pairs.value, triple[is_triple] >> np.uint64(8))
                at = np.flatnonzero(is_pair)
                # the window takes in one more word while the triples, and so the pairs, within it are frequent
                three = np.zeros(len(words) + LONGEST, bool)
                three[:len(triple)] = is_triple & is_pair[:-1] & is_pair[1:]
                lead = [np.ones(len(at), bool)]
                for k in range(LONGEST - 2):
                    lead.append(lead[-1] & three[at + k])
                length = 1 + np.sum(lead, axis=0)
                text = buf.tobytes()
                spans = list(zip(ws.tolist(), we.tolist()))
                held.update([(langs[d], *[text[a:b] for a, b in spans[i:i + n]], *PAD[n])
                             for i, n, d in zip(at.tolist(), length.tolist(), doc[at].tolist())])
                if len(held) > COUNTED:
                    yield _rows(held, LONGEST + 1)
        if held:
            yield _rows(held, LONGEST + 1)

    columns = ", ".join(f"{w} string" for w in WORDS)
    return (docs.mapInArrow(run, f"lang string, {columns}, c long")
            .groupBy("lang", *WORDS).agg(F.sum("c").alias("c")))


PAD = [(None,) * (LONGEST - n) for n in range(LONGEST + 1)]


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases of up to ``LONGEST`` words with ``f >= least``, and ``lang, n``."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = write_stage(word_counts(docs), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("c").alias("n"))
    frequent = sc.broadcast(_frequent_words(words, least))
    pairs = sc.broadcast(_frequent_runs(docs, frequent, least))
    windows = write_stage(_windows(docs, frequent, pairs), "phrase-windows")
    # every prefix of a window, by its number of words; a prefix that reaches into the padding is no phrase
    depth = sum((F.grouping(w).cast("int") for w in WORDS), F.lit(0))
    rolled = (windows.rollup("lang", *WORDS).agg(F.sum("c").alias("f"), (F.lit(LONGEST) - depth).alias("words"))
              .filter((F.col("words") >= 2) & (F.col("f") >= least)))
    rolled = rolled.filter(reduce(lambda a, b: a & b, [
        (F.col("words") <= k) | F.col(w).isNotNull() for k, w in enumerate(WORDS)]))
    phrases = rolled.select("lang", F.concat_ws(" ", *WORDS).alias("phrase"), "words", "f")
    single = words.filter(F.col("c") >= least).select("lang", F.col("w1").alias("phrase"), F.lit(1).alias("words"),
                                                      F.col("c").alias("f"))
    return write_stage(single.unionByName(phrases), "phrase-counts"), sizes


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by their weakest cut."""
    return ranked(*phrase_counts(docs, least), top)


def ranked(counts: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """The ``collocations`` of the ``phrase_counts``."""
    candidates = counts.filter("words >= 2").withColumn("_w", F.split("phrase", " "))
    part = lambda a, k: F.array_join(F.slice("_w", a, k), " ")
    # words inside a longer candidate that is as frequent
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda a: part(a, k))))
    inside = (candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("_longer")))
    kept = (candidates.join(inside, ["lang", "phrase"], "left")
            .filter(F.col("_longer").isNull() | (F.col("_longer") < F.col("f"))))
    cuts = kept.select("lang", "phrase", "words", F.col("f").alias("a"), "_w",
                       F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("_k"))
    cuts = cuts.select("lang", "phrase", "a", "_k", part(F.lit(1), F.col("_k")).alias("_left"),
                       part(F.col("_k") + 1, F.col("words") - F.col("_k")).alias("_right"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"])
    cuts = cuts.join(sizes, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_up", (exact("a") * exact("n")) * F.lit(1000).cast("decimal(4,0)")).withColumn(
        "_down", exact("l") * exact("r")).withColumn("score", F.expr("_up div _down"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_c"))
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (weakest.select("lang", "phrase", "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"), "n",
                           F.col("_c.score").alias("score"))
            .withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
size AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
lengths AS (SELECT unnest(range(1, {LONGEST + 1})) AS words),
gram AS (
  SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
  FROM words, lengths WHERE len(w) >= words),
f AS (SELECT lang, words, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, words, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE words >= 2),
inside AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT c.lang, f, unnest(list_transform(range(1, c.words - lengths.words + 2),
             lambda i: array_to_string(w[i:i + lengths.words - 1], ' '))) AS phrase
    FROM c, lengths WHERE lengths.words >= 2 AND lengths.words < c.words) GROUP BY ALL),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, k.words AS k, array_to_string(w[1:k.words], ' ') AS lp,
         array_to_string(w[k.words + 1:], ' ') AS rp
  FROM c JOIN lengths k ON k.words < c.words LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.longer IS NULL OR i.longer < c.f),
scored AS (
  SELECT cut.*, l.f AS l, r.f AS r, n,
         ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp
  JOIN size ON size.lang = cut.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= {TOP}
"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
