"""Operator 8: toxicity by a counterfactual-regularised classifier.

The model is a logistic regression over the words of a text and their first letters (4, 5 and 6 bytes, so that
inflected forms share features), hashed to ``DIMENSIONS`` features, present or not.  Only features whose class
association is clear in the sample (likelihood ratio at least ``CLEAR``) and identity terms get weights.
For every labelled text that names a group, copies are made with each identity term swapped for another of its kind,
and the loss adds ``PENALTY`` times the squared change of the score's logit: the model cannot lean on which group
is named, so neutral mentions keep low scores.

Only the fit is bounded: it takes the ``sample`` labelled rows that come first by a hash of the id.  Their feature
indices come to the driver, at most ``sample`` times the words of a text.  Scoring is one Arrow map over all
rows with the broadcast weights (``DIMENSIONS`` floats), without a shuffle.

Defined cases: a null or empty text has no features and gets the score of the bias alone; rows without a label, with a
null label or with a null id do not train; without a training row every score is 0.0; with one class the score is
that class's share, smoothed; a repeated id trains once for each labelled row; an empty table gives an empty result;
columns other than ``doc_id, text`` (and ``toxic`` of the labels) are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.llm.common import LOWER, NOT_ALNUM, joined, read_table, span_hashes, text_chunks, word_spans

DIMENSIONS = 1 << 20
SAMPLE = 6000
PREFIXES = (4, 5, 6)
CLEAR = 8.0
PENALTY = 1.0
THRESHOLD = 0.3
# terms of one kind stand in for each other
IDENTITY_TERMS = (
    ("woman", "man", "girl", "boy"), ("women", "men", "girls", "boys"), ("female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("african", "european", "american", "mexican", "chinese", "indian", "turkish"),
    ("immigrant", "refugee", "citizen"), ("immigrants", "refugees", "citizens"),
    ("old", "young", "elderly"), ("disabled", "blind", "deaf"),
)


def text_features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct and in order of the text."""
    out = []
    for first, chunk in text_chunks(texts):
        buf, starts = joined(chunk)
        ws, we = word_spans(buf, NOT_ALNUM)
        doc = np.searchsorted(starts, ws, "right") - 1 + first
        docs, ends, begins = [doc], [we], [ws]
        for k in PREFIXES:
            longer = we - ws > k
            docs.append(doc[longer])
            begins.append(ws[longer])
            ends.append(ws[longer] + k)
        f = span_hashes(LOWER[buf], np.concatenate(begins), np.concatenate(ends)) & np.uint64(DIMENSIONS - 1)
        out.append(np.unique(np.concatenate(docs) * DIMENSIONS + f.astype(np.int64)))
    pairs = np.concatenate(out) if out else np.zeros(0, np.int64)
    return pairs // DIMENSIONS, pairs % DIMENSIONS


def _word_feature(word: str) -> int:
    buf = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(buf, np.array([0]), np.array([len(buf)]))[0] & np.uint64(DIMENSIONS - 1))


def _association(feature: np.ndarray, positive_row: np.ndarray, positive: float, n: int) -> np.ndarray:
    """The likelihood ratio statistic of each feature's presence against the class, 0 where it speaks for class 0."""
    a = np.bincount(feature, weights=positive_row, minlength=DIMENSIONS)
    k = np.bincount(feature, minlength=DIMENSIONS).astype(float)

    def part(seen, expected):
        return seen * np.log(np.where(seen > 0, seen, 1) / np.maximum(expected, 1e-12))

    rate = positive / n
    g = 2 * (part(a, k * rate) + part(k - a, k * (1 - rate))
             + part(positive - a, (n - k) * rate) + part(n - positive - k + a, (n - k) * (1 - rate)))
    return np.where(a > k * rate, g, 0.0)


def _swaps(kinds: Sequence[Sequence[str]]) -> dict[int, list[int]]:
    """For every identity term's feature the features of the terms of its kind."""
    out = {}
    for kind in kinds:
        codes = [_word_feature(t) for t in kind]
        out.update({c: [x for x in codes if x != c] for c in codes})
    return out


def _penalised_pairs(row: np.ndarray, feature: np.ndarray, swaps: dict[int, list[int]]) -> np.ndarray:
    """(term, other term, how many texts) of all swaps in the texts that name a group.

    A swap leaves all other words, so the change of the logit is the difference of two weights; nothing changes
    where the other term is in the text too, and its feature stays present.
    """
    counts: dict[tuple[int, int], int] = {}
    named = np.isin(feature, np.fromiter(swaps, np.int64, len(swaps)))
    inside: dict[int, set[int]] = {}
    for r, f in zip(row[named].tolist(), feature[named].tolist()):
        inside.setdefault(r, set()).add(f)
    for terms in inside.values():
        for f in terms:
            for other in swaps[f]:
                if other not in terms:
                    counts[f, other] = counts.get((f, other), 0) + 1
    return np.array([(a, b, n) for (a, b), n in counts.items()], np.int64).reshape(-1, 3)


def fit(row: np.ndarray, feature: np.ndarray, label: np.ndarray, kinds: Sequence[Sequence[str]] = IDENTITY_TERMS,
        penalty: float = PENALTY, ridge: float = 5e-4, steps: int = 300, clear: float = CLEAR) -> np.ndarray:
    """Weights of the features and, last, the bias; Adam on the whole sample.

    ``row, feature``: the present features of each labelled text.
    """
    w = np.zeros(DIMENSIONS + 1)
    n, positive = len(label), float(label.sum())
    if n == 0:
        w[-1] = -1e9
        return w
    w[-1] = np.log((positive + 0.5) / (n - positive + 0.5))
    if positive in (0, n):
        return w
    swaps = _swaps(kinds)
    often = _association(feature, label[row], positive, n) >= clear
    # an identity term acts through its word alone, so that the swap of the word is the whole change
    often[text_features([t for kind in kinds for t in kind])[1]] = False
    often[list(swaps)] = True
    row, feature = row[often[feature]], feature[often[feature]]
    used, x = np.unique(feature, return_inverse=True)
    pairs = _penalised_pairs(row, feature, swaps)
    both = np.searchsorted(used, pairs[:, :2])
    seen = np.isin(pairs[:, :2], used)  # a term that no text holds keeps weight 0
    weight = penalty * pairs[:, 2] / n
    v, b = np.zeros(len(used)), w[-1]
    m = s = np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=v[x], minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / n
        grad = np.bincount(x, weights=error[row], minlength=len(used)) + ridge * v
        if len(pairs):
            ends = np.where(seen, v[np.minimum(both, len(used) - 1)], 0.0)
            change = 2 * weight * (ends[:, 0] - ends[:, 1])
            for side, sign in ((0, 1), (1, -1)):
                np.add.at(grad, both[seen[:, side], side], sign * change[seen[:, side]])
        g = np.append(grad, error.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-9)
        v, b = v - move[:-1], b - move[-1]
    w[used], w[-1] = v, b
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **settings) -> np.ndarray:
    """Fits on the ``sample`` labelled rows that come first by a hash of the id."""
    rows = (labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y"))
            .filter("_id IS NOT NULL AND _y IS NOT NULL").orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample))
    texts = docs.select("doc_id", "text").join(rows, F.col("doc_id") == F.col("_id")).select("text", "_y")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, feature = text_features(batch.column(0).to_pylist())
            ends = np.searchsorted(row, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32())),
                 batch.column(1).cast(pa.float64())], names=["f", "y"])

    table = texts.mapInArrow(encode, "f array<int>, y double").toArrow()
    lists = table.column("f").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    lengths = np.asarray(lists.value_lengths(), np.int64)
    return fit(np.repeat(np.arange(len(lengths)), lengths), np.asarray(lists.flatten(), np.int64),
               np.asarray(table.column("y"), float), **settings)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            row, feature = text_features(batch.column(1).to_pylist())
            z = np.bincount(row, weights=w[feature], minlength=batch.num_rows) + w[-1]
            with np.errstate(over="ignore"):  # the bias of an untrained model gives exactly 0
                p = 1 / (1 + np.exp(-np.clip(z, -1000, 700)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out(doc_id: str = "doc_id"):
    """Rows that never train: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out())
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
