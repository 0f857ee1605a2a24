"""Operator 12: hard negatives of anchor vectors by cover trees over norm-augmented candidates.

Candidates get one more coordinate, ``sqrt(M^2 - |x|^2)`` with M the greatest norm of their tree, and anchors a zero
there: then ``2 q.x = |q|^2 + M^2 - d(q, x)^2``, so a ball around a node bounds the inner products of all below it.

Trees: candidates are dealt by a hash into shards of about ``SHARD`` points; a task builds a cover tree of each shard.
The covering radii shrink by ``BASE`` from level to level: a node's points are covered by farthest-first centres until
each lies within the level's radius of one; a node of at most ``LEAF`` points is a leaf, and so is
one whose balls would hold only a few points each, as around vectors without clusters.  Each node keeps its own
covering radius, the greatest distance to a point below it.

Search: best-first descent.  Of the open nodes the one with the greatest bound comes next; nodes whose bounds lie
outside of every window that is still wanted are skipped, and so are nodes below a window's last found score.  Leaves
are verified by exact integer inner products.  Positives are one open window of the anchor's own label; each positive's
score then gives a window of the other labels.

Layout: anchors are a set of queries, in groups of about ``GROUP``; for each (shard, group) a partition reads the tree
and then streams the anchors past it, so a task holds one tree and one batch.  Each (anchor, shard) hands on its first
few rows, which are merged by a limited window.  Copies (rows of equal label and vector) are one point with its smallest
ids, as many as can ever be asked for, since all others come after them: a vector that a third of all rows hold is one
point.  Trees and rows go through the shared folder and shuffles, never through the driver.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; repeated rows
(equal id, label and vector) count once; rows that share an id but not the rest are rows of their own, and none of
them is another row to the anchor of that id; a shorter vector counts as filled up with zeros; a row's scores must fit
64 bits (an error otherwise); ties go to the smaller id; anchors without positives, and positives without negatives,
have no rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
import sys
from bisect import insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caremart.llm.common import read_table
from caremart.plans.materialize import write_stage

SHARD, GROUP, LEAF = 8192, 50_000, 512
FULL = 8  # points of a ball on average, at least
BASE = 1.3
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
RATIO = (80, 100)  # a negative's score is at least this share of the positive's
EXACT = 1 << 53


class CoverTree:
    """A cover tree of some points (rows of whole numbers) with their labels and ascending ids."""

    def __init__(self, points: np.ndarray, labels: Sequence[int], ids: Sequence[Sequence[int]], leaf: int = LEAF,
                 base: float = BASE):
        squares = (points * points).sum(axis=1)
        self.top = float(squares.max())
        extra = np.sqrt(np.maximum(0.0, self.top - squares))
        augmented = np.column_stack([points, extra])
        order = np.arange(len(points))
        root = int(np.argmin(((augmented - augmented.mean(axis=0)) ** 2).sum(axis=1)))
        centre, low, high, first, count = [root], [0], [len(points)], [0], [0]
        radius = [float(self._distances(augmented, augmented[root]).max())]
        least = 1e-6 * (1 + math.sqrt(self.top))
        k = 0
        while k < len(centre):
            own = order[low[k]:high[k]]
            if len(own) > leaf and radius[k] > least:
                level = math.floor(math.log(radius[0] / radius[k], base) + 1e-9) + 1
                balls = self._cover(augmented, own, centre[k], radius[0] / base ** level)
                if balls is None:
                    k += 1
                    continue
                centres, groups, radii = balls
                first[k], count[k] = len(centre), len(centres)
                order[low[k]:high[k]] = np.concatenate(groups)
                ends = low[k] + np.cumsum([len(g) for g in groups])
                centre += centres
                low += [int(e) - len(g) for e, g in zip(ends, groups)]
                high += ends.tolist()
                radius += radii
                first += [0] * len(centres)
                count += [0] * len(centres)
            k += 1
        self.centres = points[centre]
        self.radius = np.array(radius) * (1 + 1e-9) + least
        self.first, self.count, self.low, self.high = first, count, low, high
        self.points = np.ascontiguousarray(points[order])
        self.labels = np.asarray(labels)[order]
        self.ids = [tuple(ids[i]) for i in order.tolist()]

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(data))
        return tree

    @staticmethod
    def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
        gap = points - centre
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _cover(self, augmented: np.ndarray, own: np.ndarray, centre: int, reach: float):
        """Centres, points and radii of the balls that cover a node's points: farthest first, until all are in reach.

        None, if they would hold fewer than ``FULL`` points on average.
        """
        points = augmented[own]
        centres = [centre]
        nearest = np.zeros(len(own), np.int64)
        distance = self._distances(points, augmented[centre])
        while distance.max() > reach:
            if len(centres) > 1 and (len(centres) + 1) * FULL > len(own):
                return None
            i = int(distance.argmax())
            d = self._distances(points, points[i])
            closer = d < distance
            nearest[closer] = len(centres)
            distance[closer] = d[closer]
            centres.append(int(own[i]))
        order = np.argsort(nearest, kind="stable")
        cuts = np.searchsorted(nearest[order], np.arange(1, len(centres)))
        parts = np.split(order, cuts)
        return centres, [own[p] for p in parts], [float(distance[p].max()) for p in parts]

    def _exact(self, rows: np.ndarray, q: np.ndarray, size: float) -> np.ndarray:
        """Integer inner products; in Python's whole numbers where doubles would round."""
        if size * math.sqrt(self.top) < EXACT:
            return (rows @ q).astype(np.int64)
        whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in rows]
        return np.array(whole, object)

    def search(self, q: np.ndarray, label: int, same: bool, windows: Sequence[tuple[float, float]], k: int,
               but: int | None = None) -> list[list[tuple[int, int]]]:
        """The first ``k`` (-score, id) of each window (least, most), of the label or of all others, in order.

        ``but`` is an id that takes no part.
        """
        square = float(q @ q)
        size = math.sqrt(square)
        slack = 1e-9 * (square + self.top) + 1e-6
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        least, most = [w[0] for w in windows], [w[1] for w in windows]

        def bounds(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            product, r = self.centres[a:b] @ q, self.radius[a:b]
            d = np.sqrt(np.maximum(0.0, square + self.top - 2 * product))
            upper = np.minimum((square + self.top - np.maximum(0.0, d - r) ** 2) / 2, product + size * r)
            lower = np.maximum((square + self.top - (d + r) ** 2) / 2, product - size * r)
            return upper + slack, lower - slack

        up, down = bounds(0, 1)
        heap = [(-float(up[0]), float(down[0]), 0)]
        while heap:
            up, down, node = heapq.heappop(heap)
            up = -up
            if up < min(least):
                break
            if not any(up >= a and down <= b for a, b in zip(least, most)):
                continue
            if self.count[node]:
                a = self.first[node]
                ups, downs = bounds(a, a + self.count[node])
                wanted = np.zeros(len(ups), bool)
                for x, y in zip(least, most):
                    wanted |= (ups >= x) & (downs <= y)
                for i in np.flatnonzero(wanted).tolist():
                    heapq.heappush(heap, (-float(ups[i]), float(downs[i]), a + i))
                continue
            a, b = self.low[node], self.high[node]
            scores = self._exact(self.points[a:b], q, size)
            right = self.labels[a:b] == label if same else self.labels[a:b] != label
            right &= (scores >= min(least)) & (scores <= max(most))
            at = np.flatnonzero(right)
            for i in at[np.argsort(-scores[at], kind="stable")].tolist():
                score = int(scores[i])
                if score < min(least):
                    break
                for w, (x, y) in enumerate(zip(least, most)):
                    if x <= score <= y:
                        for one in self.ids[a + i]:
                            if one != but:
                                insort(found[w], (-score, one))
                        if len(found[w]) >= k:
                            del found[w][k:]
                            least[w] = max(x, -found[w][-1][0])
        return found


def _vectors(rows: pa.Array) -> np.ndarray:
    """Lists of doubles as rows, filled up with zeros."""
    values = [np.asarray(v, float) for v in rows.to_numpy(zero_copy_only=False)]
    out = np.zeros((len(values), max(map(len, values), default=0)))
    for row, v in zip(out, values):
        row[:len(v)] = v
    return out


def valid_rows(embeddings: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part; ``x`` has the floors of the scaled components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
                             & F.coalesce(finite, F.lit(False)))
    whole = F.transform("embedding", lambda x: _floor(x.cast("double") * scale))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       (F.col("label") if label is None else label).cast("long").alias("label"), whole.alias("x")).distinct()


def _floor(x: Column) -> Column:
    """The floor as a double; a double beyond 2^52 is whole already."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x) + F.lit(0.0)


def cover_trees(rows: DataFrame, copies: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """``_shard, tree``: a packed tree of every shard of the ``valid_rows``, and the number of shards."""
    # of equal label and vector only the smallest ids can be asked for
    nth = F.row_number().over(Window.partitionBy("label", "x").orderBy("vec_id"))
    points = write_stage(rows.withColumn("_nth", nth).filter(F.col("_nth") <= copies).drop("_nth"), "mining-points")
    shards = max(1, -(-points.count() // shard))
    points = points.withColumn("_shard", F.pmod(F.xxhash64("label", "x"), F.lit(shards)).cast("int"))
    partitions = max(1, min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = (points.select("_shard", "label", "x", "vec_id").repartition(partitions, "_shard")
               .sortWithinPartitions("_shard", "label", "x", "vec_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        own = None

        def build() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            labels = table.column("label").to_numpy()
            x = _vectors(table.column("x").combine_chunks())
            ids = table.column("vec_id").to_pylist()
            new = np.concatenate(([True], (labels[1:] != labels[:-1]) | (x[1:] != x[:-1]).any(axis=1)))
            starts = np.flatnonzero(new).tolist()
            groups = [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]
            tree = CoverTree(x[starts], labels[starts], groups).packed()
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([tree], pa.binary())],
                                              names=["_shard", "tree"])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and int(numbers[a]) != own:
                    yield build()
                own = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield build()

    return write_stage(ordered.mapInArrow(run, "_shard int, tree binary"), "cover-trees"), shards


def _meet(trees: DataFrame, shards: int, anchors: DataFrame, run, schema: str) -> DataFrame:
    """Every anchor streams past every tree: partitions of (shard, group of anchors), the tree first."""
    spark = anchors.sparkSession
    groups = max(1, -(-anchors.count() // GROUP))
    one = F.lit(None)
    left = trees.select("_shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(0).alias("_kind"),
                        "tree", *[one.cast(f.dataType).alias(f.name) for f in anchors.schema])
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard"),
                           F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("_group"), F.lit(1).alias("_kind"),
                           one.cast("binary").alias("tree"), *anchors.columns)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = (left.unionByName(right).repartition(max(1, min(n, shards * groups)), "_shard", "_group")
            .sortWithinPartitions("_shard", "_group", "_kind"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own = None, None
        for batch in batches:
            shard, group, kind = (batch.column(c).to_numpy() for c in range(3))
            at = 0
            while at < len(kind):
                if kind[at] == 0:
                    tree, own = CoverTree.unpacked(batch.column(3)[at].as_py()), (shard[at], group[at])
                    at += 1
                    continue
                other = (kind[at:] == 0) | (shard[at:] != shard[at]) | (group[at:] != group[at])
                end = at + int(np.argmax(np.append(other, True)))
                if own == (shard[at], group[at]):  # else no point fell into the shard, so it has no tree
                    yield run(tree, batch.slice(at, end - at))
                at = end

    return both.mapInArrow(stream, schema)


def _fit(x: np.ndarray, tree: CoverTree) -> np.ndarray:
    """Anchors with as many components as the tree's points (the rest meets zeros)."""
    width = tree.points.shape[1]
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def positives(trees: DataFrame, shards: int, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """``vec_id, label, x, positive_id, positive_score`` of each anchor's first ``k`` other rows of its label."""
    def run(tree: CoverTree, batch: pa.RecordBatch) -> pa.RecordBatch:
        q = _fit(_vectors(batch.column(6)), tree)
        out = [(row, i, -s) for row, (one, label) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
               for s, i in tree.search(q[row], label, True, [(-math.inf, math.inf)], k, one)[0]]
        rows, ids, scores = zip(*out) if out else ((), (), ())
        rows = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(4).take(rows), batch.column(5).take(rows), batch.column(6).take(rows),
             pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
            names=["vec_id", "label", "x", "positive_id", "positive_score"])

    found = _meet(trees, shards, anchors.select("vec_id", "label", "x"), run,
                  "vec_id long, label long, x array<double>, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("vec_id", "label", "x").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("_nth", nth).filter(F.col("_nth") <= k).drop("_nth")


def negatives(trees: DataFrame, shards: int, pairs: DataFrame, k: int = NEGATIVES, ratio: tuple[int, int] = RATIO
              ) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the ``positives``."""
    share, whole = ratio
    # an anchor has a few positives only; they travel together, and are known by their place (ids may repeat)
    few = F.array_sort(F.collect_list(F.struct("positive_score", "positive_id")))
    anchors = pairs.groupBy("vec_id", "label", "x").agg(few.alias("_few")).select(
        "vec_id", "label", "x", F.col("_few.positive_id").alias("ids"), F.col("_few.positive_score").alias("scores"))

    def run(tree: CoverTree, batch: pa.RecordBatch) -> pa.RecordBatch:
        q = _fit(_vectors(batch.column(6)), tree)
        out = []
        columns = (batch.column(c).to_pylist() for c in (4, 5, 7, 8))
        for row, (anchor, label, ids, scores) in enumerate(zip(*columns)):
            windows = [(-(-share * s // whole), s) for s in scores]
            for place, best in enumerate(tree.search(q[row], label, False, windows, k)):
                out += [(anchor, row, place, ids[place], i, scores[place], -t) for t, i in best]
        anchor, row, place, one, i, s, t = zip(*out) if out else ((),) * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), batch.column(5).take(pa.array(row, pa.int64())),
             batch.column(6).take(pa.array(row, pa.int64())), *[pa.array(v, pa.int64()) for v in (place, one, i, s, t)]],
            names=["anchor_id", "label", "x", "_place", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = _meet(trees, shards, anchors, run, "anchor_id long, label long, x array<double>, _place long, "
                  "positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "label", "x", "_place").orderBy(F.desc("negative_score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def mine(rows: DataFrame, anchors: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         ratio: tuple[int, int] = RATIO, shard: int = SHARD) -> DataFrame:
    """The hard negatives of the anchors (a condition on the ``valid_rows``)."""
    rows = write_stage(rows, "mining-rows")
    trees, shards = cover_trees(rows, max(n_positives + 1, n_negatives), shard)
    pairs = write_stage(positives(trees, shards, rows.filter(anchors), n_positives), "mining-positives")
    return negatives(trees, shards, pairs, n_negatives, ratio)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = valid_rows(read_table(spark, sf_dir, "embeddings"), label)
    return mine(rows, F.col("vec_id") % 100 == 0)


SQL = f"""
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         list_inner_product(a.x, b.x)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id, row_number() OVER (
         PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND {RATIO[0]} * positive_score <= {RATIO[1]} * score AND score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
