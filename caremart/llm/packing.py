"""Operator 11: packing documents into sequences of fixed length by concatenating and cutting.

All documents, each followed by an end id, are read as one stream of ids that is cut every ``SIZE`` ids.  Where a
document lies in the stream comes from two passes of prefix sums:

1. Every task encodes its documents, in Arrow batches, and notes each document's place in the task's own stream, with
   its ids, in a written table; what a task wrote stays as it is, so a lost executor changes no place.
2. The tasks' totals, one row for each task, are summed up in order.  A task's offset plus a document's own place is its
   place in the whole stream, and the cuts of a document follow from that alone: no document looks at another.

A document that lies across a cut gives one piece for each sequence it touches.  ``goes_on`` and ``comes_from`` are the
boundary records: the piece's document goes on in the next sequence, or came from the one before.  Only the stream's
last sequence can be shorter than ``SIZE``, so the padding of the whole corpus is less than one sequence.

The offsets are joined to the documents on the task's number: Spark broadcasts them while the written table is below
``spark.sql.autoBroadcastJoinThreshold``; beyond it each task's documents meet their offset in a shuffle.  No text or
id is gathered: ``sequences`` groups at most ``SIZE`` ids.

Texts are encoded by their distinct words: a tokeniser with word ends drops white space and never makes a token across
it, so the ids of a text are those of its words, and a word that recurs in a task is encoded once (``WordEncoder``).
Tokenisers without word ends are refused.

Defined cases: a null or empty text, or one of white space, has only the end id; a null id is kept; repeated rows are
separate documents; the strings of special tokens inside texts are encoded as the library does by default; an empty
table gives an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caremart.llm.common import read_table
from caremart.plans.materialize import write_stage

TOKENIZER = "word_bpe_49k.json"
SIZE = 2048
END = 1
KNOWN = 300_000  # distinct words whose ids a task holds from one slice to the next
CALL, LINE = 32_000, 32  # new words of an encoding call, and of one of its strings
SLICE = 4 << 20  # bytes of text that are encoded together
WIDTHS = (np.dtype("<u2"), np.dtype("<u4"))
PLACE = np.int32  # of an id in a slice; Arrow holds at most 2^31 bytes of text in a batch
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
SMALL[0x0A] = 0x20
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[97:123] = True
MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = True


class WordEncoder:
    """The ids of whole texts, put together from the ids of their distinct words.

    Words of plain small letters, which normalising leaves alone, go to the bare merges; all others take the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Split
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        settings = json.loads(self.full.to_str())
        steps = (settings["normalizer"] or {}).get("normalizers", [])
        if not settings["model"].get("end_of_word_suffix") or "Lowercase" not in [x["type"] for x in steps]:
            raise ValueError("packing splits texts at spaces; this tokeniser has no word ends or keeps case")
        suffix = settings["model"]["end_of_word_suffix"]
        settings.update(normalizer=None, added_tokens=[])
        self.bare = Tokenizer.from_str(json.dumps(settings))
        self.bare.pre_tokenizer = Split(" ", "removed")
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100))})
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.width = WIDTHS[len(self.ends) > 1 << 16]
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        encode = getattr(self.full, "encode_batch_fast", self.full.encode_batch)
        for k in range(0, len(texts), CALL):
            for e in encode(texts[k:k + CALL], add_special_tokens=False):
                yield np.array(e.ids, self.width).tobytes()

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words of small letters, some words in one string; each ends with a token of a word's end."""
        encode = getattr(self.bare, "encode_batch_fast", self.bare.encode_batch)
        size = self.width.itemsize
        for k in range(0, len(words), CALL):
            part = words[k:k + CALL]
            lines = [" ".join(part[i:i + LINE]) for i in range(0, len(part), LINE)]
            lines = [x if x.isascii() else x.translate(self.spelling) for x in lines]
            ids = np.array([i for e in encode(lines, add_special_tokens=False) for i in e.ids], self.width)
            data, cuts = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
            yield from (data[a:b] for a, b in zip([0, *cuts], cuts))

    def _ids(self, words: list[str]) -> list[bytes]:
        """The packed ids of each word."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        found = [known.get(w) for w in words]
        at = [i for i, p in enumerate(found) if p is None]
        new = pa.array([words[i] for i in at], pa.string())
        plain = pc.match_substring_regex(new, "^[a-z]+$")
        letters = pc.and_not(pc.match_substring_regex(new, "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"), plain)
        for encode, mask in ((self._letters, plain), (self._letters, letters),
                             (self._whole, pc.invert(pc.or_(plain, letters)))):
            part = new.filter(mask).to_pylist()
            known.update(zip(part, encode(part), strict=True))
        for i in at:
            found[i] = known[words[i]]
        return found

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, with the end id, and all ids one after the other."""
        texts = texts.fill_null("")
        # strings of special tokens are found in the text as it stands: such texts are encoded whole
        special = pc.match_substring(texts, "<|")
        split = pc.split_pattern(separated(pc.if_else(special, "", texts)), " ")
        coded = split.flatten().dictionary_encode()
        packed = self._ids(coded.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(packed), self.width)
        size = np.array([len(p) for p in packed], np.int64) // self.width.itemsize
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        stream = pool[np.arange(upto[-1], dtype=PLACE) + np.repeat((first[at] - upto[:-1]).astype(PLACE), n)]
        cuts = upto[split.offsets.to_numpy() - split.offsets[0].as_py()]
        rows = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        if len(rows):
            whole = [np.frombuffer(p, self.width) for p in self._whole(texts.take(pa.array(rows)).to_pylist())]
            stream = np.insert(stream, np.repeat(cuts[rows], [len(w) for w in whole]), np.concatenate(whole))
            longer = np.zeros(len(cuts), np.int64)
            longer[rows + 1] = [len(w) for w in whole]
            cuts = cuts + np.cumsum(longer)
        return np.diff(cuts) + 1, np.insert(stream, cuts[1:], end)


def separated(texts: pa.Array) -> pa.Array:
    """The texts with small letters A-Z and U+00C0-U+00DE, line breaks as spaces, and a space between letter and mark.

    None of it changes the ids: letters are made small anyway, and a mark after a letter starts a new token.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    low = SMALL[buf]
    if len(low) > 1:
        latin = np.zeros(len(low), bool)  # the second byte of a letter from U+00C0 to U+00FF
        latin[1:] = (low[:-1] == 0xC3) & ~np.isin(low[1:], (0x97, 0xB7))
        low[latin & (low < 0x9F)] += 0x20
        gaps = np.flatnonzero((LETTER[low[:-1]] | latin[:-1]) & MARK[low[1:]]) + 1
        low = np.insert(low, gaps, 0x20)
        offsets = offsets + np.searchsorted(gaps, offsets)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)),
                                                           pa.py_buffer(np.ascontiguousarray(low))])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE`` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        before = int(size[row - 1]) if row else 0
        end = max(row + 1, int(np.searchsorted(size, before + SLICE, "right")))
        yield row, end
        row = end


def token_stream(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, path: str | None = None) -> DataFrame:
    """A written table ``doc_id, part, place, tokens, ids``: each document's ids, packed, and its place in its task's stream.

    ``tokenizer`` is a file name of the ``public_tokenizers`` package, found on the executor; ``path`` names another
    file instead.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder = WordEncoder(path or public_tokenizers.path(tokenizer))
        place = 0
        for batch in batches:
            for a, b in _slices(batch.column(1)):
                tokens, ids = encoder.encode(batch.column(1).slice(a, b - a), end)
                upto = np.concatenate(([0], np.cumsum(tokens)))
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(
                    (upto * encoder.width.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)),
                     pa.array(place + upto[:-1]), pa.array(tokens), packed],
                    names=["doc_id", "part", "place", "tokens", "ids"])
                place += int(upto[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, part int, place long, tokens long, ids binary")
    return write_stage(rows, "token-stream")


def offsets(stream: DataFrame) -> DataFrame:
    """``part, offset``: the ids of all earlier tasks; a window over one row for each task."""
    totals = stream.groupBy("part").agg(F.sum("tokens").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return write_stage(totals.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("offset")),
                       "token-offsets")


def pieces(stream: DataFrame, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of every document of a ``token_stream``, cut every ``size`` ids.

    ``doc_id, start`` (the document's ids before the piece), ``length, ids_crc32, doc_tokens, sequence_id, offset``
    (where the piece starts in its sequence), ``comes_from, goes_on``; with ``with_ids`` also ``ids``, an array.
    """
    at = (stream.join(offsets(stream), "part")
          .select("doc_id", (F.col("offset") + F.col("place")).alias("_at"), "tokens", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(1).to_numpy()
            tokens = batch.column(2).to_numpy()
            n = (first + tokens - 1) // size - first // size + 1  # pieces of each document
            doc = np.repeat(np.arange(len(n)), n)
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sequence = first[doc] // size + number
            begin = np.maximum(sequence * size, first[doc])
            finish = np.minimum((sequence + 1) * size, (first + tokens)[doc])
            start, length = begin - first[doc], finish - begin
            crc, ids, row, whole = [], [], -1, None
            for d, a, k in zip(doc.tolist(), start.tolist(), length.tolist()):
                if d != row:
                    row, raw = d, batch.column(3)[d].as_buffer()
                    whole = np.frombuffer(raw, f"<u{len(raw) // int(tokens[d])}").astype("<u4")
                piece = whole[a:a + k]
                crc.append(zlib.crc32(piece.tobytes()))
                if with_ids:
                    ids.append(piece.astype(np.int32))
            columns = [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                       pa.array(tokens[doc]), pa.array(sequence), pa.array(begin - sequence * size),
                       pa.array(start > 0), pa.array(start + length < tokens[doc])]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "comes_from", "goes_on"]
    kind = stream.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "comes_from boolean, goes_on boolean")
    if with_ids:
        names.append("ids")
        schema += ", ids array<int>"
    return at.mapInArrow(run, schema)


def sequences(cut: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """``sequence_id, ids, n_ids, bounds``: pieces with ids put together, padded to ``size``; a few ids in all are padding.

    ``bounds`` lists each piece's document, start, length and offset; a piece holds one id at least, so a group has
    at most ``size`` pieces.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    packed = cut.groupBy("sequence_id").agg(rows.alias("_rows"))
    ids = F.flatten(F.transform("_rows", lambda r: r["ids"]))
    return packed.select(
        "sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), F.lit(size) - F.size(ids))).alias("ids"),
        F.size(ids).cast("long").alias("n_ids"),
        F.transform("_rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["start"].alias("start"),
                                                r["length"].alias("length"), r["offset"].alias("offset"))).alias("bounds"))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = SIZE, end: int = END, path: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; see ``token_stream`` and ``pieces``."""
    return pieces(token_stream(docs, tokenizer, end, path), size, with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
