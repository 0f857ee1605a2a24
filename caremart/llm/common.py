"""Helpers shared by the operators of this subpackage: table reads and numpy text kernels.

The kernels work on the UTF-8 bytes of a batch of texts at once, inside Spark tasks.  Words are maximal runs
of bytes outside ``[\\x20\\x09-\\x0D]`` (``WORD`` class) or maximal runs of letters, digits and non-ASCII bytes
(``ALNUM`` class, lower-cased), hashed to 64 bits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_REGEX = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[np.r_[48:58, 65:91, 97:123, 128:256]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the name behind underscores, that no column of ``df`` has (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_own_columns(df: DataFrame, names: Sequence[str], step) -> DataFrame:
    """``step(df)`` with the columns of ``df``, also those that are named like one that ``step`` adds."""
    taken = {n.lower() for n in names}
    aside = {c: free_name(df, f"_own_{c}") for c in df.columns if c.lower() in taken}
    out = step(df.withColumnsRenamed(aside))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in df.columns])


def n_words(text: str = "text"):
    """Number of ``WORD`` words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        p = np.full(size, _BASE, np.uint64)
        q = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _POWERS["p"], _POWERS["q"] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def word_spans(buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs of bytes outside the class ``breaks``."""
    word = ~breaks[buf]
    edge = np.diff(np.concatenate(([False], word, [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:len(buf)], out=c[1:])
    return mix64((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def text_chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``limit`` bytes, as (index of the first, UTF-8 bytes); null is empty."""
    first, size, out = 0, 0, []
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if out and size + len(b) > limit:
            yield first, out
            first, size, out = i, 0, []
        out.append(b)
        size += len(b) + 1
    if out:
        yield first, out


def joined(chunk: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of a chunk's texts, each followed by a newline, and the offset at which each text starts."""
    lens = np.fromiter((len(b) + 1 for b in chunk), np.int64, len(chunk))
    return np.frombuffer(b"\n".join(chunk) + b"\n", np.uint8), np.concatenate(([0], np.cumsum(lens)[:-1]))


# executors need no copy of this package: functions that run there are shipped by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
