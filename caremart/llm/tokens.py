"""Operator 2: token counts of whole texts.

Texts are encoded inside Arrow batches and only the lengths leave the task.  With a byte-level BPE a text is cut at
safe boundaries: before a space that follows a character which is no white space, the pre-tokeniser always starts a
new piece, and special strings hold no space.  So the counts of the cuts add up to the text's count, a text of any
length is encoded in short strings, and a cut that occurs often (a word with its space) is encoded once per task.
Encoding calls get about ``CALL_CHARS`` characters each.  A text with white space before a space (where a
cut would not be safe) is encoded whole, as is every text for other kinds of tokeniser.

Defined cases: a null text is empty (0 bytes, 0 tokens); repeated rows are counted separately; an empty table gives
an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from caremart.llm.common import read_table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CALL_CHARS = 200_000
CACHED = 400_000
UNSAFE = re.compile(r"\s ")


def _counter(path: str):
    """A function from a list of strings to their token counts, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda xs: [len(x) for x in model.encode(xs, num_threads=1)]
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    encode = getattr(t, "encode_batch_fast", t.encode_batch)
    return lambda xs: [len(x) for x in encode(xs, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row's whole text.

    ``tokenizer`` is a file name of the ``public_tokenizers`` package, found on the executor; ``path`` names another
    file instead.
    """
    safe = tokenizer.startswith("byte_bpe")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        lengths = _counter(path or public_tokenizers.path(tokenizer))
        known: dict[str, int] = {}  # tokens of each cut

        def encode(cuts: set[str]) -> None:
            call, size = [], 0
            for c in cuts:
                call.append(c)
                size += len(c)
                if size >= CALL_CHARS:
                    known.update(zip(call, lengths(call)))
                    call, size = [], 0
            known.update(zip(call, lengths(call)))

        def learn(cuts: set[str]) -> None:
            # a stop or comma after a letter is a piece, and a token, of its own
            ended = {c: c[:-1] for c in cuts if c[-1:] in (".", ",") and c[-2:-1].isalpha()} if safe else {}
            encode({ended.get(c, c) for c in cuts} - known.keys())
            known.update((c, known[word] + 1) for c, word in ended.items())

        for batch in batches:
            n_bytes, n_tokens = [], []
            texts = [v.as_py() or "" for v in batch.column(1)]
            start = 0
            while start < len(texts):  # groups of texts of about CALL_CHARS * 10 characters
                group, size, new = [], 0, set()
                while start < len(texts) and size < 10 * CALL_CHARS:
                    t = texts[start]
                    first, *words = t.split(" ") if safe and not UNSAFE.search(t) else [t]
                    group.append([first, *[" " + w for w in words]])
                    new.update(group[-1])
                    n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
                    size += len(t)
                    start += 1
                if len(known) > CACHED:
                    known.clear()
                learn(new - known.keys())
                n_tokens += [sum(map(known.__getitem__, cuts)) for cuts in group]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                 pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
