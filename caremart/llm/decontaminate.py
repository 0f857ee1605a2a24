"""Operator 10: benchmark decontamination with a BM25 index and block-max WAND.

The test items are the index, the training passages are the queries.  An item is cut into segments of at most
``SEGMENT`` words; the index holds, for each word, the segments that contain it with their BM25 impacts divided by
the segment's own score (its score for itself), in blocks of ``BLOCK`` segments with each block's greatest impact.
Every passage of every document (``PASSAGE`` words, every ``STRIDE`` words) is a query of its distinct words, and all
segments that score at least ``RETRIEVE`` are retrieved by block-max WAND: the block maxima of a passage's words are
summed for all passages of a batch at once, blocks whose sum stays below the threshold are skipped, and in the others
WAND moves a cursor for each word from pivot to pivot.  Segments with many common words, whose bounds are weak, share
blocks.

A retrieved item is verified against the text around the passage: of its question (all sentences but the last) and of
its answer (the last sentence) at least ``OVERLAP`` of the distinct word triples must occur.

The index is broadcast, in shards of about ``SHARD`` items or ``SHARD_CHARS`` characters of items, whichever are more
shards, one map over the documents for each; a shard's items pass through the driver, which builds its index.
Documents are not shuffled or gathered.

Words are maximal runs of letters, digits and non-ASCII bytes with A-Z lower-cased.  Defined cases: null or empty texts
and items without words hit nothing; an item with one sentence is split into its first three quarters and the rest; an
item or part of fewer than three words is one n-gram of its own length; items with equal texts, and repeated rows,
each give hits; null ids are kept as they are; without items or documents the result is empty; other columns are not
read.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from caremart.llm.common import LOWER, NOT_ALNUM, joined, mix64, read_table, span_hashes, text_chunks, word_spans

SEGMENT, STRIDE, BLOCK = 48, 32, 4
PASSAGE = 2 * STRIDE
RETRIEVE, OVERLAP = 0.5, 0.6
SHARD, SHARD_CHARS = 10_000, 4_000_000
CELLS = 4_000_000  # bounds held at once
K1, B = 1.2, 0.75


def text_words(text: str | None) -> list[int]:
    """The hashes of a text's words in order."""
    buf = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return span_hashes(LOWER[buf], *word_spans(buf, NOT_ALNUM)).tolist() if len(buf) else []


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out) + words[k:len(words) - n + 1 + k]
    return mix64(out)


def split_item(text: str) -> tuple[list[int], list[int]]:
    """Question and answer words: the last sentence that has words is the answer."""
    sentences = [w for w in map(text_words, text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".")) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = max(1, len(words) * 3 // 4)
    return words[:cut], words[cut:]


class Index:
    """Postings of the segments of a shard of items, and what verification needs of each item."""

    def __init__(self, items: Sequence[tuple[int | None, str | None]]):
        self.items, self.parts, segments = [], [], []
        for item_id, text in items:
            words = text_words(text)
            if not words:
                continue
            parts = []
            for part in split_item(text):
                if part:
                    n = min(3, len(part))
                    parts.append((n, np.unique(grams(np.array(part, np.uint64), n))))
            pieces = -(-len(words) // SEGMENT)
            step = -(-len(words) // pieces)
            segments += [(len(self.items), words[k:k + step]) for k in range(0, len(words), step)]
            self.items.append((item_id, len(words)))
            self.parts.append(parts)
        n = len(segments)
        mean = sum(len(w) for _, w in segments) / max(1, n)
        held = Counter(w for _, words in segments for w in set(words))
        segments.sort(key=lambda s: -sum(held[w] for w in s[1]) / len(s[1]))
        self.owner = [i for i, _ in segments]
        self.n_blocks = -(-n // BLOCK)
        found: dict[int, list[tuple[int, float]]] = {}
        for s, (_, words) in enumerate(segments):
            impact = {}
            for w, tf in Counter(words).items():
                idf = np.log(1 + (n - held[w] + 0.5) / (held[w] + 0.5))
                impact[w] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean)))
            own = sum(impact.values())
            for w, x in impact.items():
                found.setdefault(w, []).append((s, x / own))
        self.vocabulary = np.array(sorted(found), np.uint64)
        self.postings: list[dict[int, tuple[list[int], list[float]]]] = []  # of each word, by block
        most = []
        for w in self.vocabulary.tolist():
            by_block: dict[int, tuple[list[int], list[float]]] = {}
            for s, x in found[w]:
                ids, impacts = by_block.setdefault(s // BLOCK, ([], []))
                ids.append(s)
                impacts.append(x)
            self.postings.append(by_block)
            most.append([(block, max(impacts)) for block, (_, impacts) in by_block.items()])
        self.word_at = np.concatenate(([0], np.cumsum([len(m) for m in most]))).astype(np.int64)
        self.block = np.array([b for m in most for b, _ in m], np.int64)
        self.most = np.array([x for m in most for _, x in m])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def search(self, words: Sequence[int], threshold: float, blocks: Sequence[int]) -> list[tuple[int, float]]:
        """WAND inside some blocks: all (segment, score) of at least ``threshold`` for distinct words (their numbers)."""
        out, limit, end = [], threshold - 1e-9, len(self.owner)
        for block in blocks:
            lists = [self.postings[w][block] for w in words if block in self.postings[w]]
            cursors = [[ids[0], 0, ids, impacts, max(impacts)] for ids, impacts in lists]
            while cursors:
                cursors.sort(key=lambda c: c[0])
                bound, pivot = 0.0, None
                for k, c in enumerate(cursors):
                    bound += c[4]
                    if bound >= limit:
                        pivot = k
                        break
                if pivot is None:
                    break
                target = cursors[pivot][0]
                if cursors[0][0] == target:  # all cursors before the pivot stand on it: score it
                    score = sum(c[3][c[1]] for c in cursors if c[0] == target)
                    if score >= limit:
                        out.append((target, score))
                    target += 1
                for c in cursors:
                    while c[0] < target:
                        c[1] += 1
                        c[0] = c[2][c[1]] if c[1] < len(c[2]) else end
                cursors = [c for c in cursors if c[0] < end]
        return out

    def hits(self, words: np.ndarray, cuts: np.ndarray, retrieve: float, overlap: float
             ) -> list[tuple[int, int, float, float, float]]:
        """(document, item, score, question overlap, answer overlap) of the verified items of a batch.

        ``words`` are the words of all documents, document ``d`` has those from ``cuts[d]`` to ``cuts[d + 1]``.
        """
        at = np.flatnonzero(self.filter[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return []
        place = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == words[at]
        at, place = at[known], place[known]
        # strides are numbered through all documents, with an empty one after each document: passage k is strides k, k + 1
        doc = np.searchsorted(cuts, at, "right") - 1
        stride_0 = np.concatenate(([0], np.cumsum(-(-np.diff(cuts) // STRIDE) + 1)))
        size = len(self.vocabulary)
        key = np.unique((stride_0[doc] + (at - cuts[doc]) // STRIDE) * size + place)
        stride, place = key // size, key % size
        found: dict[tuple[int, int], tuple[float, float, float]] = {}
        step = max(1, CELLS // self.n_blocks)
        for low in range(0, int(stride_0[-1]), step):
            a, b = np.searchsorted(stride, (low, low + step + 1))
            own = place[a:b]
            n = self.word_at[own + 1] - self.word_at[own]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.word_at[own], n)
            cell = np.repeat(stride[a:b] - low, n) * self.n_blocks + self.block[entry]
            bound = np.bincount(cell, weights=self.most[entry], minlength=(step + 1) * self.n_blocks)
            bound = bound.reshape(-1, self.n_blocks)
            passages, blocks = np.nonzero(bound[:-1] + bound[1:] >= retrieve - 1e-9)
            firsts = np.flatnonzero(np.diff(passages, prepend=-1))
            for i, j in zip(firsts, np.append(firsts[1:], len(passages))):
                passage = int(passages[i]) + low
                p, q = np.searchsorted(stride, (passage, passage + 2))
                for s, score in self.search(np.unique(place[p:q]).tolist(), retrieve, blocks[i:j].tolist()):
                    d = int(np.searchsorted(stride_0, passage, "right")) - 1
                    item = self.owner[s]
                    if (d, item) in found and found[d, item][0] >= score:
                        continue
                    length = self.items[item][1]
                    start = int(cuts[d]) + (passage - int(stride_0[d])) * STRIDE
                    region = words[max(int(cuts[d]), start - length):min(int(cuts[d + 1]), start + PASSAGE + length)]
                    shares = [np.isin(g, grams(region, n)).mean() for n, g in self.parts[item]]
                    if min(shares) >= overlap:
                        found[d, item] = (score, float(shares[0]), float(shares[-1]))
        return sorted((*k, *v) for k, v in found.items())


def find_items(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP,
               shard: int = SHARD) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every verified item of every document."""
    ids = items.schema["item_id"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {ids}, score double, question_overlap double, answer_overlap double"
    id_type = to_arrow_type(items.schema["item_id"].dataType)
    found = [docs.select("doc_id", "text").mapInArrow(_searcher(index, retrieve, overlap, id_type), schema)
             for index in _indexes(items, shard)]
    return reduce(DataFrame.unionByName, found)


def without_items(docs: DataFrame, items: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP,
                  shard: int = SHARD) -> DataFrame:
    """``docs`` without the documents in which an item is verified; no shuffle."""
    at = docs.columns.index("text")
    for index in _indexes(items, shard):
        docs = docs.mapInArrow(_cleaner(index, at, retrieve, overlap), docs.schema)
    return docs


def _indexes(items: DataFrame, shard: int) -> Iterator:
    """Broadcast indexes of the items, each of about ``shard`` of them, or of ``SHARD_CHARS`` characters."""
    spark = items.sparkSession
    rows = items.select("item_id", "text")
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-count // shard), -(-size // SHARD_CHARS))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    for k in range(shards):
        part = rows.filter(F.col("_shard") == k).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in part]))


def _batch_hits(index: Index, texts: Sequence[str | None], retrieve: float, overlap: float) -> Iterator[tuple]:
    if not index.items:
        return
    for first, chunk in text_chunks(texts):
        buf, starts = joined(chunk)
        ws, we = word_spans(buf, NOT_ALNUM)
        words = span_hashes(LOWER[buf], ws, we)
        for d, *rest in index.hits(words, np.append(np.searchsorted(ws, starts), len(ws)), retrieve, overlap):
            yield (first + d, *rest)


def _cleaner(shared, at: int, retrieve: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[h[0] for h in _batch_hits(shared.value, batch.column(at).to_pylist(), retrieve, overlap)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _searcher(shared, retrieve: float, overlap: float, ids: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = [(d, index.items[item][0], *rest) for d, item, *rest in
                     _batch_hits(index, batch.column(1).to_pylist(), retrieve, overlap)]
            d, i, s, q, a = zip(*found) if found else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(d, pa.int64())), pa.array(i, ids), pa.array(s, pa.float64()),
                 pa.array(q, pa.float64()), pa.array(a, pa.float64())],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
