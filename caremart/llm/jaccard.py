"""Operator 6: n-gram Jaccard join with prefix filters under several global token orders.

Every text is the set of its distinct word shingles (64-bit hashes).  Texts with equal sets form one class; the join
works on classes.  Two classes are linked when ``100 * |intersection| >= percent * |union|``.

1. Shingles are dealt by their hash into buckets, as packed arrays of one row for each chunk of texts and bucket.
   A bucket finds the shingles that at least two classes share.
   Shingles in a large share of the texts of some chunk (``FREQUENT``) would be a hot bucket: they are found first,
   are few whatever the size of the corpus, and go straight to their classes, dealt by class.
2. A class whose own shingles (shared with no other class) are more than ``100 - percent`` in a hundred can have no
   link; it is left out, and frequencies are counted among the rest.
3. A global token order puts own shingles first.  Linked classes must share a shingle within the first
   ``n - ceil(percent / 100 * n) + 1`` of each, under every such order.  The order by frequency makes the candidates;
   they must also fit by size and by the positions of the shared shingle (what can still follow), and share a prefix
   shingle under the other orders (two independent hash orders) before they are verified on their whole sets.
4. Groups of near copies are not expanded into all pairs: in every posting list, first only the class with the fewest
   own shingles is paired with the others.  Links found so make components.  Then lists that still hold
   several components are finished: classes outside the list's largest component are paired with all classes of
   other components in it, under the same filters.  No pair within a component can add anything to it, so no link
   between components is lost.

All tables are written to the shared checkpoint folder between these steps.  To the driver come only counts and the
frequent shingles.

Defined cases: a text with fewer words than a shingle is one shingle, its whole sequence; a text without words (null,
empty, white space) has the empty set, no links and is its own component; repeated rows have equal sets and so one
component; a null id counts for nothing as the smallest id, and a component of null ids only has the null id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caremart.llm.common import (LOWER, SPACES, free_name, joined, mix64, read_table, span_hashes, text_chunks,
                                 word_spans)
from caremart.plans.materialize import write_stage

SIZE, PERCENT = 3, 90
BUCKET_TOKENS, LEAST_BUCKETS = 1_000_000, 64
LOW = (1 << 48) - 1  # bits of a shingle's hash that are sent; the bucket holds up to 15 more
FREQUENT, FEW = 128, 8  # a shingle in 1 / FREQUENT of a chunk's texts, and FEW at least, may be frequent
CHUNK = 4 << 20
TEXTS = 1024  # texts whose sets a task holds at a time, to find those that may be frequent
PIECE = 1 << 18  # bytes of text that are hashed at a time
PARTS = 4  # parts in which the shingles of a bucket are sorted


def shingle_sets(texts: list, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for _, chunk in text_chunks(texts, PIECE):
        buf, starts = joined(chunk)
        buf = LOWER[buf]
        ws, we = word_spans(buf, SPACES)
        words = span_hashes(buf, ws, we)
        cuts = np.append(np.searchsorted(ws, starts), len(ws))
        for d in range(len(chunk)):
            w = words[cuts[d]:cuts[d + 1]]
            n = min(size, len(w))
            g = w[:len(w) - n + 1].copy() if n else w
            for k in range(1, n):
                g = mix64(g) + w[k:len(w) - n + 1 + k]
            yield np.unique(mix64(g + np.uint64(n)))


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a, b = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), mix64(s + np.uint64(0xC2B2AE3D27D4EB4F))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS))


def _set_rows(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (doc_id, n, ka, kb), and rows (token, c) of shingles frequent in a chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in _few(batches):
            ns, keys, new = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), size):
                key = _key(s)
                ns.append(len(s))
                keys.append(key)
                if key not in seen:
                    seen.add(key)
                    new.append(s)
            tokens, c = np.unique(np.concatenate(new), return_counts=True) if new else (np.zeros(0, np.uint64),) * 2
            often = c >= max(FEW, len(new) // FREQUENT)
            tokens, c = tokens[often].view(np.int64), c[often].astype(np.int64)
            rows, more = batch.num_rows, len(tokens)
            ka, kb = zip(*keys) if keys else ((), ())

            def column(values, kind, first):
                blank = pa.nulls(more if first else rows, kind)
                parts = [pa.array(values, kind), blank] if first else [blank, pa.array(values, kind)]
                return pa.concat_arrays(parts)

            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([batch.column(0), pa.nulls(more, batch.column(0).type)]), column(ns, pa.int64(), True),
                 column(ka, pa.int64(), True), column(kb, pa.int64(), True), column(tokens, pa.int64(), False),
                 column(c, pa.int64(), False)], names=["doc_id", "n", "ka", "kb", "token", "c"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, ka long, kb long, token long, c long")


def _dealt(docs: DataFrame, size: int, buckets: int, frequent: np.ndarray) -> DataFrame:
    """Packed rows (bucket, ka, kb, runs, tokens): the shingles of each class of a chunk that fall into the bucket.

    Buckets from ``buckets`` on hold frequent shingles, dealt by class.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def pack(sets: list, keys: list) -> pa.RecordBatch:
        often = shared.value
        full = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
        sets.clear()  # held once from here on
        ka, kb = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
        bucket = ((full >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
        tokens = full & np.uint64(LOW) | (bucket % (1 << 15) << 48).astype(np.uint64)  # the shingle's name from here on
        if len(often) and len(tokens):
            at = np.minimum(np.searchsorted(often, full), len(often) - 1)
            hot = often[at] == full
            bucket[hot] = buckets + ka[owner[hot]] % buckets
            del at, hot
        del full
        order = np.argsort(bucket, kind="stable")  # the owners stand in order
        tokens, owner, bucket = tokens[order], owner[order], bucket[order]
        del order
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            heads = a + _heads(owner[a:b])
            runs = np.diff(np.append(heads, b)).astype(np.uint32)
            rows.append((int(bucket[a]), ka[owner[heads]].tobytes(), kb[owner[heads]].tobytes(), runs.tobytes(),
                         (tokens[a:b] if bucket[a] >= buckets else _six(tokens[a:b])).tobytes()))
        columns = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
            names=["bucket", "ka", "kb", "runs", "tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sets, keys, held = [], [], 0
        for batch in _few(batches):
            for s in shingle_sets(batch.column(0).to_pylist(), size):
                key = _key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                sets.append(s)
                keys.append(key)
                held += s.nbytes
                if held > CHUNK:
                    yield pack(sets, keys)
                    sets, keys, held = [], [], 0
        yield pack(sets, keys)

    return docs.select("text").mapInArrow(run, "bucket long, ka binary, kb binary, runs binary, tokens binary")


def _six(tokens: np.ndarray) -> np.ndarray:
    """The low six bytes of each token."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _tokens(raw: bytes, bucket: int, buckets: int) -> np.ndarray:
    if bucket >= buckets:
        return np.frombuffer(raw, np.uint64)
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() | np.uint64(bucket % (1 << 15) << 48)


def _heads(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a run of equal values (of all the arrays) starts."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    for y in more:
        new[1:] |= y[1:] != y[:-1]
    return np.flatnonzero(new)


def _shared_part(part: int, packed: list, runs: list, numbers: list, bucket: int, buckets: int) -> tuple:
    """Of one part of a bucket: the shingles that several classes share (all, if frequent), and their classes."""
    tokens, owner = [], []
    for raw, run, number in zip(packed, runs, numbers):
        t = _tokens(raw, bucket, buckets)
        mine = t % np.uint64(PARTS) == part
        tokens.append(t[mine])
        owner.append(np.repeat(number, run)[mine])
    tokens, owner = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    del order
    once = _heads(tokens, owner)  # a class may come from many tasks
    tokens, owner = tokens[once], owner[once]
    sizes = np.diff(np.append(_heads(tokens), len(tokens)))
    keep = np.repeat(sizes, sizes) > (0 if bucket >= buckets else 1)
    return tokens[keep], owner[keep]


def _shared_tokens(buckets: int):
    """Of one bucket: for every class its shingles that another class has too; frequent ones are taken as shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs, packed, bucket = [], [], [], 0
        for batch in batches:
            for bucket, a, b, run, raw in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
                runs.append(np.frombuffer(run, np.uint32))
                packed.append(raw)
        batch = None
        ka, kb = (np.concatenate(x) for x in zip(*keys))
        del keys
        order = np.lexsort((kb, ka))  # number the classes
        new = (np.diff(ka[order], prepend=0) != 0) | (np.diff(kb[order], prepend=0) != 0)
        new[0] = True
        number = np.empty(len(ka), np.uint32)
        number[order] = np.cumsum(new) - 1
        ka, kb = ka[order][new], kb[order][new]
        numbers = np.split(number, np.cumsum([len(r) for r in runs])[:-1])
        del order, new, number
        # equal shingles are in one part, so a part at a time holds what is sorted
        found = [_shared_part(part, packed, runs, numbers, bucket, buckets) for part in range(PARTS)]
        tokens, owner = (np.concatenate(x) for x in zip(*found))
        del found, packed, runs, numbers
        order = np.argsort(owner, kind="stable")
        tokens, owner = tokens[order].view(np.int64), owner[order]
        heads = _heads(owner)
        offsets = pa.array(np.append(heads, len(owner)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ka[owner[heads]]), pa.array(kb[owner[heads]]), pa.ListArray.from_arrays(offsets, pa.array(tokens))],
            names=["ka", "kb", "tokens"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """``id, comp``: the smallest id that each end of the edges ``x, y`` reaches.

    Smallest labels spread along the edges, and every label jumps to its label's label, until nothing changes.
    """
    both = write_stage(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))),
                       "edges")
    labels = write_stage(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("x")).alias("comp")),
                         "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(
            F.min("comp").alias("_near"))
        spread = labels.join(near, "id", "left").select("id", "comp", F.least("comp", "_near").alias("_next"))
        jump = labels.select(F.col("id").alias("_next"), F.col("comp").alias("_jump"))
        after = write_stage(spread.join(jump, "_next", "left").select(
            "id", F.least("_next", "_jump").alias("comp"), (F.least("_next", "_jump") < F.col("comp")).alias("_moved")),
            "labels")
        labels = after.select("id", "comp")
        if after.filter("_moved").isEmpty():
            return labels


def _may_link(o, nx, ny, percent: int):
    return 100 * o >= percent * (nx + ny - o)


def _verified(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``x, y`` that are linked: prefixes meet under the other orders, then the whole sets are compared."""
    side = lambda s: sigs.select(F.col("cid").alias(s), *[F.col(c).alias(f"{c}_{s}")
                                                          for c in ("n", "tokens", "pre1", "pre2")])
    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y")
    both = both.filter(F.arrays_overlap("pre1_x", "pre1_y")).filter(F.arrays_overlap("pre2_x", "pre2_y"))
    return both.filter(_may_link(F.size(F.array_intersect("tokens_x", "tokens_y")), F.col("n_x"), F.col("n_y"),
                                 percent)).select("x", "y")


def _links(sigs: DataFrame, percent: int) -> DataFrame:
    """``id, comp`` of all classes with a link; ``sigs``: cid, n, own, tokens (by frequency), pre1, pre2."""
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("own")
    posts = write_stage(sigs.select("cid", "n", "own", F.posexplode(
        F.slice("tokens", 1, F.greatest(prefix, F.lit(0)).cast("int"))).alias("pos", "token"))
        .withColumn("at", F.col("own") + F.col("pos")).drop("pos"), "postings")
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("own", "cid", "n", "at")).alias("h"))
    lists = lists.filter("size > 1").select("token", F.col("h.cid").alias("x"), F.col("h.n").alias("nx"),
                                            F.col("h.at").alias("ax"))
    room = lambda: F.least(F.col("nx") - F.col("ax"), F.col("n") - F.col("at"))
    star = posts.join(lists, "token").filter((F.col("cid") != F.col("x")) & _may_link(
        room(), F.col("nx"), F.col("n"), percent))
    star = star.select(F.least("x", "cid").alias("x"), F.greatest("x", "cid").alias("y")).distinct()
    first = write_stage(_verified(star, sigs, percent), "links")
    comps = components(first)

    posts = write_stage(posts.join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn(
        "comp", F.coalesce("comp", "cid")), "open-postings")
    # of every list that holds several components: its largest one, and the smallest set in it
    parts = posts.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    lists = (parts.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("k", "comp")).alias("top"),
                                        F.min("least").alias("least"))
             .filter("comps > 1").select("token", F.col("top.comp").alias("top"), "least"))
    open_ = posts.join(lists, "token")
    # a set that could not even meet the smallest set of the list is finished
    open_ = open_.filter(_may_link(F.col("n") - F.col("at"), F.col("n"), F.greatest(
        F.col("least"), F.ceil(F.col("n") * percent / 100)), percent))
    open_ = write_stage(open_, "open-members")
    x = open_.filter("comp != top").select("token", F.col("cid").alias("x"), F.col("n").alias("nx"),
                                           F.col("at").alias("ax"), F.col("comp").alias("cx"))
    y = open_.select("token", F.col("cid").alias("y"), "n", "at", "comp", "top")
    pairs = x.join(y, (x["token"] == y["token"]) & (F.col("cx") != F.col("comp"))
                   & ((F.col("comp") == F.col("top")) | (F.col("x") < F.col("y")))
                   & _may_link(room(), F.col("nx"), F.col("n"), percent)).select("x", "y").distinct()
    second = write_stage(_verified(pairs, sigs, percent), "links")
    return components(first.unionByName(second)) if not second.isEmpty() else comps


def link_components(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; the ids may be numbers or strings."""
    spark = docs.sparkSession
    rows = write_stage(_set_rows(docs, size), "shingle-sets")
    each = rows.filter("n IS NOT NULL").select("doc_id", "n", "ka", "kb")
    classes = write_stage(each.filter("n > 0").groupBy("ka", "kb", "n").agg(F.min("doc_id").alias("first_id"))
                          .withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = classes.agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens")).first()
    # at most 2 * FREQUENT * (shingles of a text) of them, for each would be in 1 / (2 * FREQUENT) of the sets
    often = (rows.filter("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c"))
             .filter(F.col("c") >= max(FEW, total["sets"] // (2 * FREQUENT))).select("token").toArrow())
    frequent = np.sort(np.asarray(often.column(0), np.int64).view(np.uint64))
    buckets = max(LEAST_BUCKETS, (total["tokens"] or 0) // BUCKET_TOKENS)
    found = _dealt(docs, size, buckets, frequent).groupBy("bucket").applyInArrow(
        _shared_tokens(buckets), "ka long, kb long, tokens array<long>")
    found = (found.groupBy("ka", "kb").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
             .join(classes, ["ka", "kb"]).filter(F.size("tokens") * 100 >= F.col("n") * percent))
    found = write_stage(found.select("cid", "n", "tokens"), "shared-tokens")
    # frequencies are counted among the classes that are left
    flat = found.select("cid", F.explode("tokens").alias("token"))
    again = flat.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    kept = (flat.join(again, "token").groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(
        F.struct("c", "token"))), lambda t: t["token"]).alias("tokens"))
        .join(found.select("cid", "n"), "cid").filter(F.size("tokens") * 100 >= F.col("n") * percent)
        .withColumn("own", F.col("n") - F.size("tokens")))
    prefix = F.greatest(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("own"), F.lit(0)).cast("int")

    def first_by(seed: int):
        keyed = F.sort_array(F.transform("tokens", lambda t: F.struct(F.xxhash64(F.lit(seed), t).alias("h"), t.alias("t"))))
        return F.transform(F.slice(keyed, 1, prefix), lambda t: t["t"])

    sigs = write_stage(kept.withColumns({"pre1": first_by(1), "pre2": first_by(2)}), "signatures")
    comps = _links(sigs, percent)
    # the smallest id of each class, then of each component
    members = classes.join(comps.withColumnRenamed("id", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    lowest = members.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    members = members.join(lowest, "comp").select("ka", "kb", F.col("n").alias("_n"), "component_id")
    out = each.join(members, (each["ka"] == members["ka"]) & (each["kb"] == members["kb"]) & (each["n"] == members["_n"]),
                    "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, then text hash, then other columns.

    Rows are told apart by id and text, so a repeated id with another text is another document.
    """
    row = F.concat(F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~")), F.lit(":"),
                   F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    linked = link_components(docs.select(row.alias("doc_id"), "text"), percent, size)
    key, at = free_name(docs, "_row"), free_name(docs, "_at")
    stay = linked.select(F.col("component_id").alias(key)).distinct()
    rows = docs.withColumn(key, row).join(stay, key, "left_semi")
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*others))
    return rows.withColumn(at, first).filter(F.col(at) == 1).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read_table(spark, sf_dir, "documents"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
