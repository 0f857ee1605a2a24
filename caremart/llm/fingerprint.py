"""Operator 3: document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines).  Every paragraph is hashed to a wide vector, and a
fingerprint is the sum of the vectors of all paragraphs, lane by lane modulo a power of two:

* ``EXACT`` lanes modulo 2^64, uniform in the whole paragraph (SHAKE-128): equal multisets of paragraphs have equal
  lanes, different ones differ but for a chance of about 2^-2048;
* ``NEAR`` lanes modulo 2^32, a signed count sketch of the paragraph's word triples: their inner product estimates
  how much two texts share even where an edit falls inside a paragraph.

So the order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its
vector (``combine``), without the rest of the text.

``likeness`` of two fingerprints is 1 for equal ones, else ``2ab / (aa + bb)`` of the near lanes, from 0 up to below 1.

Neighbours: the query also needs the next document in ascending id.  Rows are dealt into ranges of (id, hash of the
text) whose bounds are fixed (quantiles of the ids; an id that fills several ranges is cut by the hash), so that a
retried task sees the same ranges, and null or repeated ids are spread.  The bounds are one constant array, searched by
halving; each range is sorted and read as a stream, and the first row of the following range, found by a join on the
range's first key, is added to it.  The text is shuffled once.

Defined cases: a null text is empty; the empty text has the zero fingerprint; null ids stand before all others;
rows with the same id are ordered by a hash of their text, then the text; in a table of one row the next document is the row itself; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.llm.common import SPACES, joined, mix64, read_table, span_hashes, text_chunks, word_spans

EXACT = 32
NEAR = 256
_NULL_ID = -(1 << 63)


def _near_lanes(texts: list[str]) -> np.ndarray:
    """The signed sketch of the word triples of every text; a triple ends with its paragraph."""
    out = np.zeros((len(texts), NEAR), np.uint32)
    for first, chunk in text_chunks(texts):
        buf, starts = joined(chunk)
        ws, we = word_spans(buf, SPACES)
        if not len(ws):
            continue
        h = span_hashes(buf, ws, we)
        par = np.cumsum(buf == 0x0A)[ws]  # the paragraph of each word; texts end with a newline, so never shared
        triple = h.copy()
        for k in (1, 2):
            same = par[k:] == par[:-k]
            triple[:len(h) - k][same] += h[k:][same] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64))
        triple = mix64(triple)
        doc = np.searchsorted(starts, ws, "right") - 1
        lane = (triple & np.uint64(NEAR - 1)).astype(np.int64)
        sign = 1 - 2 * ((triple >> np.uint64(20)) & np.uint64(1)).astype(np.int64)
        sums = np.bincount(doc * NEAR + lane, weights=sign, minlength=len(chunk) * NEAR)
        out[first:first + len(chunk)] = sums.astype(np.int64).reshape(-1, NEAR).astype(np.uint32)
    return out


def _exact_lanes(text: str) -> np.ndarray:
    digests = [hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * EXACT)
               for p in text.split("\n")] if text else []
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)


def _pack(exact: np.ndarray, near: np.ndarray) -> str:
    return base64.b64encode(exact.tobytes() + near.tobytes()).decode()


def _unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[:8 * EXACT], np.uint64), np.frombuffer(raw[8 * EXACT:], np.uint32)


def fingerprint(text: str | None) -> str:
    """The fingerprint of one text."""
    return _pack(_exact_lanes(text or ""), _near_lanes([text or ""])[0])


def combine(fingerprint_: str, paragraphs: list[str], sign: int = 1) -> str:
    """The fingerprint after inserting (sign 1) or deleting (sign -1) paragraphs, without the rest of the text."""
    exact, near = (x.copy() for x in _unpack(fingerprint_))
    for p in paragraphs:
        e = np.frombuffer(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(8 * EXACT), np.uint64)
        n = _near_lanes([p])[0]
        exact, near = (exact + e, near + n) if sign > 0 else (exact - e, near - n)
    return _pack(exact, near)


def _likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if np.array_equal(a[0], b[0]):
        return 1.0
    x, y = a[1].astype(np.int32).astype(np.float64), b[1].astype(np.int32).astype(np.float64)
    size = x @ x + y @ y
    return float(min(0.999999, max(0.0, 2 * (x @ y) / size))) if size else 0.0


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    return _likeness(_unpack(a), _unpack(b))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row; no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            near = _near_lanes(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_pack(_exact_lanes(t), n) for t, n in zip(texts, near)], pa.string())],
                names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


_KEY = "array<struct<id:bigint,h:bigint>>"


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Keys that cut the rows into about ``parts`` ranges: quantiles of the ids, and equal parts of a frequent id's hashes."""
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    ids = rows.agg(F.percentile_approx("_id", F.array(*map(F.lit, cuts)), F.lit(max(10_000, 50 * parts)))).first()[0]
    return sorted((i, -(1 << 63) + (k << 64) // n) for i, n in Counter(ids or []).items() for k in range(n))


def _range_of(bounds: list[tuple[int, int]], id_: str = "_id", h: str = "_h"):
    """The number of bounds up to a row's key, by halving; the bounds are a single constant of the plan."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"id": i, "h": h_} for i, h_ in bounds])), _KEY)
    key = F.struct(F.col(id_).alias("id"), F.col(h).alias("h"))

    def halve(acc, _):
        middle = F.floor((acc["a"] + acc["b"]) / 2).cast("int")
        below = F.get(table, middle) <= key
        done = acc["a"] >= acc["b"]
        return F.struct(F.when(~done & below, middle + 1).otherwise(acc["a"]).alias("a"),
                        F.when(~done & ~below, middle).otherwise(acc["b"]).alias("b"))

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b")), halve, lambda acc: acc["a"])


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``_range, _look, _id, _h, doc_id, text``, sorted inside partitions: each range in order, then the row after it.

    The ranges' bounds and first keys, a few numbers for each range, come to the driver; rows do not.
    """
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("_id"), "doc_id",
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    bounds = _bounds(rows.select("_id"), parts or 8 * shuffle)
    rows = rows.withColumn("_range", _range_of(bounds)).withColumn("_look", F.lit(False))
    firsts = rows.groupBy("_range").agg(F.min(F.struct("_id", "_h")).alias("_first"))
    keys = sorted((r["_range"], *r["_first"]) for r in firsts.collect())
    if keys:
        # range k is followed by the first row of the next range in use; the last one by the first row of all
        after = spark.createDataFrame([(*keys[(k + 1) % len(keys)][1:], r) for k, (r, _, _) in enumerate(keys)],
                                      "_id long, _h long, _after int")
        heads = rows.drop("_range").join(F.broadcast(after), ["_id", "_h"]).groupBy("_id", "_h", "_after").agg(
            F.min("text").alias("text"))
        rows = rows.unionByName(heads.select("_id", "_h", F.col("_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                                             "text", F.col("_after").alias("_range"), F.lit(True).alias("_look")))
    order = ["_range", "_look", "_id", "_h", "text"]
    return rows.select(*order, "doc_id").repartition(shuffle, "_range").sortWithinPartitions(*order)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def neighbour_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; see the module's text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    group_chars = 4_000_000

    def groups(batches: Iterator[pa.RecordBatch]):
        """Runs of rows of about ``group_chars``; each starts with the last row of the one before."""
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                rows.append(row)
                size += len(row[3])
                if size >= group_chars and len(rows) > 1:
                    yield rows
                    rows, size = rows[-1:], len(rows[-1][3])
        if len(rows) > 1:
            yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches):
            texts = [r[3] for r in rows]
            prints = list(zip(map(_exact_lanes, texts), _near_lanes(texts)))
            at = [i for i, r in enumerate(rows[:-1]) if not r[1]]  # a look-ahead row has its own row elsewhere
            edited = [edited_text(texts[i], texts[i + 1]) for i in at]
            edited_prints = list(zip(map(_exact_lanes, edited), _near_lanes(edited)))
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[i][4] for i in at], id_type),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array([_pack(*prints[i]) for i in at], pa.string()),
                pa.array([_pack(*p) for p in edited_prints], pa.string()),
                pa.array([_likeness(prints[i], p) for i, p in zip(at, edited_prints)], pa.float64()),
                pa.array([_likeness(prints[i], prints[i + 1]) for i in at], pa.float64())], names=names)

    id_type = pa.int32() if kind == "int" else pa.int64()
    return with_next(docs).select("_range", "_look", "_id", "text", "doc_id").mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_report(read_table(spark, sf_dir, "documents"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
