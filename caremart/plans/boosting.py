"""ML5-ML7: boosted trees for the outcome bands, tuned over the reference's sixteen settings.

The fit takes the whole train side.  Its columns are coded as bins, and rows of the same bins become one cell with the
number of rows of each fold and band (the test side's with them), which gives the same sums as the rows.  The cells stay
dealt over the cluster: each round of all fits of the grid search takes one pass for each level of the trees, in which
tasks sum the gradients of their own cells in the bins of each column, and the driver sees these sums only.  Both numbers
of rounds come from one run, since the shorter one is its beginning.

Trees minimise the log-loss of the softmax of one score for each class: each round adds a tree for each class, grown
level by level from sums of gradients in the bins of each column.  A numeric column splits at a bin's upper end, a
categorical one into a level and all others, as its one-hot column would.
"""

from __future__ import annotations

import operator
import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.functions.quantiles import exact_quantiles
from caremart.plans.materialize import write_stage
from caremart.plans.model import (BANDS, CATEGORICAL, MIN_ROWS, NUMERIC, model_frame, outcome_band, stratified_folds,
                                  stratified_split)
from caremart.session import checkpoint_dir
from caremart.sources.fs import delete

PENALTY = 1.0  # of squared leaf weights
LEAST_WEIGHT = 1.0  # second derivatives in a leaf
BINS = 32  # of a numeric column
PART = (2_048, 65_536)  # cells of a partition: at least, so that passes are few tasks, and at most, so that tasks stay small
KEPT = 10  # rounds between two checkpoints of the cells' scores
DIRECT = 32  # partitions whose sums go straight to the driver


@dataclass
class Coding:
    """How columns become bins: the numeric columns' inner cuts and the categorical columns' levels."""
    cuts: dict[str, list[float]]
    levels: dict[str, list[str]]

    def __post_init__(self):
        sizes = [len(c) + 1 for c in self.cuts.values()] + [len(v) + 1 for v in self.levels.values()]
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.bins = int(sum(sizes))
        self.column = np.repeat(np.arange(len(sizes)), sizes)
        self.numeric = self.column < len(self.cuts)
        #: the first level has no one-hot column, the last bin of a categorical column holds unseen levels
        self.names = [c for c, cuts in self.cuts.items() for _ in range(len(cuts) + 1)] + [
            f"{c}_{v}" for c, vs in self.levels.items() for v in [*vs, None]]
        self.usable = np.array([bool(n) for n in self.numeric])
        for start, vs in zip(self.starts[len(self.cuts):], self.levels.values()):
            self.usable[start + 1:start + len(vs)] = True

    def codes(self, frame: pd.DataFrame) -> np.ndarray:
        """The bin of every row and column; a missing number is in its column's first bin."""
        out = [np.searchsorted(cuts, frame[c].astype(float).fillna(-np.inf).to_numpy(), "left") for c, cuts in self.cuts.items()]
        for c, vs in self.levels.items():
            at = pd.Series(range(len(vs)), index=vs)
            out.append(frame[c].astype(object).map(at).fillna(len(vs)).astype(int).to_numpy())
        return np.column_stack(out) + self.starts


def coding(frame: DataFrame, bins: int = BINS) -> Coding:
    """Exact quantiles of the numeric columns, and all levels of the categorical ones (bounded by ``frame``'s rows)."""
    probs = [i / bins for i in range(1, bins)]
    cuts = {}
    for c in NUMERIC:
        row = exact_quantiles(frame, [], c, probs, [f"q{i}" for i in range(len(probs))]).first()
        cuts[c] = sorted(set(row)) if row is not None and row[0] is not None else []
    rows = frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                            for c in CATEGORICAL])).alias("x")).select("x.*").where("v IS NOT NULL").distinct()
    levels: dict[str, list[str]] = {c: [] for c in CATEGORICAL}
    for r in rows.orderBy("c", "v").collect():
        levels[r["c"]].append(r["v"])
    return Coding(cuts, levels)


def best_features(codes: np.ndarray, y: np.ndarray, code: Coding, k: int) -> np.ndarray:
    """Which bins may split: those of the ``k`` features of the greatest ANOVA F."""
    return features_of(np.stack([np.bincount(codes[y == c].ravel(), minlength=code.bins) for c in np.unique(y)]), code, k)


def features_of(counts: np.ndarray, code: Coding, k: int) -> np.ndarray:
    """``best_features`` of the rows of each class that lie in each bin."""
    ends = [*code.starts[1:], code.bins]
    rows = counts[:, :ends[0]].sum(axis=1)  # each row lies in one bin of the first column
    counts, rows = counts[rows > 0], rows[rows > 0]
    scores = {}
    for b in np.flatnonzero(code.usable):
        name = code.names[b]
        if name not in scores:
            j = code.column[b]
            own = slice(code.starts[j], ends[j]) if code.numeric[b] else slice(b, b + 1)
            x, n = np.arange(own.start, own.stop, dtype=float) if code.numeric[b] else np.ones(1), counts[:, own].astype(float)
            mean, whole = n @ x / rows, (n.sum(axis=0) @ x) / rows.sum()
            apart = (n * (x - mean[:, None]) ** 2).sum() + ((rows - n.sum(axis=1)) * mean ** 2).sum()
            between = (rows * (mean - whole) ** 2).sum() / max(1, len(rows) - 1)
            within = apart / max(1, rows.sum() - len(rows))
            scores[name] = between / within if within > 0 else 0.0
    chosen = set(sorted(scores, key=lambda n: (-scores[n], n))[:k])
    return np.array([bool(u) and n in chosen for u, n in zip(code.usable, code.names)])


def bin_sums(codes: np.ndarray, node: np.ndarray, weights: Sequence[np.ndarray], nodes: int, bins: int) -> np.ndarray:
    """The sums of each of the rows' weights in each node and bin."""
    key, width = (node[:, None] * bins + codes).ravel(), codes.shape[1]
    return np.stack([np.bincount(key, np.repeat(w, width), nodes * bins).reshape(nodes, bins) for w in weights])


def choose(code: Coding, g: np.ndarray, h: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node the best bin to split at (-1 for none) and its gain, and the weights of the two leaves that it makes."""
    first, sums = code.starts[1] if len(code.starts) > 1 else code.bins, []
    for s in (g, h):
        running = np.cumsum(s, axis=1)
        before = np.where(code.starts > 0, running[:, code.starts - 1], 0)[:, code.column]
        sums.append((np.where(code.numeric, running - before, s), s[:, :first].sum(axis=1, keepdims=True)))
    (gl, gt), (hl, ht) = sums
    score = lambda a, b: a * a / (b + PENALTY)
    gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
    gain[~(may & (hl >= LEAST_WEIGHT) & (ht - hl >= LEAST_WEIGHT))] = -np.inf
    best, at = gain.argmax(axis=1), np.arange(len(g))
    top = gain[at, best]
    # a node without a split hands all its rows to the left
    left = [np.where(top > 1e-9, part[at, best], total[:, 0]) for part, total in sums]
    right = [total[:, 0] - own for (_, total), own in zip(sums, left)]
    leaves = np.column_stack([-own[0] / (own[1] + PENALTY) for own in (left, right)]).ravel()
    return np.where(top > 1e-9, best, -1), top, leaves


class Boosted:
    """The trees of a fit: for each round and class the splits of each level, and the leaves' weights."""

    def __init__(self, code: Coding, classes: int, rate: float):
        self.code, self.classes, self.rate = code, classes, rate
        self.trees: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.gains: dict[str, float] = {}

    def _down(self, codes: np.ndarray, node: np.ndarray, splits: np.ndarray) -> np.ndarray:
        at = splits[node]
        own = codes[np.arange(len(codes)), self.code.column[np.maximum(at, 0)]]
        left = np.where(self.code.numeric[np.maximum(at, 0)], own <= at, own == at) | (at < 0)
        return 2 * node + ~left

    def _split(self, g: np.ndarray, h: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, top, leaves = choose(self.code, g, h, may)
        for b, x in zip(best, top):
            if b >= 0:
                self.gains[self.code.names[b]] = self.gains.get(self.code.names[b], 0.0) + float(x)
        return best, leaves

    def _tree(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, may: np.ndarray, depth: int) -> tuple:
        node, levels = np.zeros(len(codes), np.int64), []
        for level in range(depth):
            best, leaves = self._split(*bin_sums(codes, node, (g, h), 1 << level, self.code.bins), may)
            levels.append(best)
            node = self._down(codes, node, best)
        return levels, leaves, node

    def fit(self, codes: np.ndarray, y: np.ndarray, may: np.ndarray, depth: int, rounds: int) -> Boosted:
        scores = np.zeros((len(y), self.classes))
        for _ in range(rounds):
            p = shares(scores)
            for c in range(self.classes):
                levels, leaves, node = self._tree(codes, p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c]), may, depth)
                self.trees.append((levels, leaves))
                scores[:, c] += self.rate * leaves[node]
        return self

    def scores(self, codes: np.ndarray, rounds: int | None = None) -> np.ndarray:
        out = np.zeros((len(codes), self.classes))
        for i, (levels, leaves) in enumerate(self.trees[:None if rounds is None else rounds * self.classes]):
            node = np.zeros(len(codes), np.int64)
            for splits in levels:
                node = self._down(codes, node, splits)
            out[:, i % self.classes] += self.rate * leaves[node]
        return out


def shares(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class BoostedModel:
    boosted: Boosted
    labels: list[str]
    train_accuracy: float
    test_accuracy: float
    feature_importance: list[tuple[str, float]]
    best_params: dict
    settings: list[tuple[dict, float]]  # every setting with its mean accuracy over the folds


@dataclass
class Fit:
    """A fit over the rows of all folds but its own (``None``: of all folds)."""
    k: int
    depth: int
    rate: float
    fold: int | None
    rounds: int


def cells(rows: DataFrame, code: Coding, labels: list[str], folds: int) -> tuple[RDD, int]:
    """Blocks of (bins, numbers of rows) of the distinct bins of rows with a ``band`` and a ``fold``, and their partitions.

    A cell has a number for the test side (fold -1) and each fold, times each label.
    """
    shared, slots = rows.sparkSession.sparkContext.broadcast((code.cuts, code.levels)), (folds + 1) * len(labels)

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Coding(*shared.value)
        for frame in frames:
            text, width = code.codes(frame).astype("<i4").tobytes(), 4 * (len(code.cuts) + len(code.levels))
            slot = (frame["fold"].to_numpy() + 1) * len(labels) + frame["band"].map(labels.index).to_numpy()
            yield pd.DataFrame({"code": [text[i:i + width] for i in range(0, len(text), width)], "slot": slot})

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bins = np.frombuffer(b"".join(frame["code"]), "<i4").reshape(len(frame), -1).astype(np.int64)
            yield pd.DataFrame({"block": [pickle.dumps((bins, frame[names].to_numpy(float)))]})

    names = [f"n{i}" for i in range(slots)]
    held = rows.select(*NUMERIC, *CATEGORICAL, "band", "fold").mapInPandas(coded, "code binary, slot int")
    held = write_stage(held.groupBy("code").agg(*[F.count_if(F.col("slot") == i).alias(n) for i, n in enumerate(names)]), "boost-cells")
    least, most = PART
    n = held.count()
    parts = max(1, min(-(-n // least), max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // most))))
    return held.repartition(parts).mapInPandas(packed, "block binary").rdd.map(lambda r: pickle.loads(r["block"])), parts


class Search:
    """Fits over the cells, all of them round by round: the cells' scores stay where the cells are."""

    def __init__(self, spark: SparkSession, blocks: RDD, parts: int, code: Coding, classes: int, folds: int):
        self.spark, self.blocks, self.code, self.classes, self.folds = spark, blocks, code, classes, folds
        self.depth = 1 if parts <= DIRECT else 2
        self.shared = blocks.context.broadcast((code.cuts, code.levels))
        self.counts = self.summed(blocks, lambda code: lambda b: np.stack([
            np.bincount(b[0].ravel(), np.repeat(w, b[0].shape[1]), code.bins) for w in b[1].T]))

    def summed(self, rdd: RDD, by: Callable) -> np.ndarray:
        """The sum over all blocks of the arrays that ``by(code)`` makes of them."""
        shared = self.shared

        def sums(blocks: Iterator) -> Iterator:
            of, out = by(Coding(*shared.value)), None
            for block in blocks:
                part = of(block)
                out = part if out is None else out + part
            return iter([] if out is None else [out])

        return rdd.mapPartitions(sums).treeReduce(operator.add, self.depth)

    def inside(self, fold: int | None) -> list[int]:
        """The sides (0 is the test side) whose rows a fit without this fold takes."""
        return [f + 1 for f in range(self.folds) if f != fold]

    def run(self, fits: list[Fit], marks: Sequence[int]) -> tuple[list[Boosted], dict[int, np.ndarray]]:
        """The fitted trees, and after each number of rounds in ``marks`` the share of each side's rows that they hit."""
        classes, sides, shared = self.classes, self.folds + 1, self.shared
        models = [Boosted(self.code, classes, f.rate) for f in fits]
        by_class = self.counts.reshape(sides, classes, -1)
        may = [features_of(by_class[self.inside(f.fold)].sum(axis=0), self.code, f.k) for f in fits]
        taken, rates, depths = [self.inside(f.fold) for f in fits], [f.rate for f in fits], [f.depth for f in fits]
        total = by_class[:, :, :self.code.starts[1]].sum(axis=(1, 2))
        state = self.blocks.map(lambda b: (*b, np.zeros((len(rates), len(b[0]), classes))))
        found, kept, last = {}, [], max(f.rounds for f in fits)
        for done in range(last + 1):
            if done:
                grown = [m.trees[-classes:] for m in models]

                def add(part: Iterator, grown=grown) -> Iterator:
                    code = Coding(*shared.value)
                    for codes, n, scores in part:
                        scores = scores.copy()
                        for own, rate, trees in zip(scores, rates, grown):
                            step = Boosted(code, classes, rate)
                            step.trees = trees
                            own += step.scores(codes)
                        yield codes, n, scores

                before, state = state, state.mapPartitions(add)
            state.persist()
            if done % KEPT == 0:
                state.checkpoint()
            if done in marks:
                def hits(code: Coding) -> Callable:
                    def of(block: tuple) -> np.ndarray:
                        codes, n, scores = block
                        n, at = n.reshape(len(codes), sides, classes), np.arange(len(codes))
                        return np.stack([n[at, :, own.argmax(axis=1)].sum(axis=0) for own in scores])
                    return of
                found[done] = self.summed(state, hits) / np.maximum(total, 1)
            if done < last:
                self._round(state, models, may, taken, depths)
            if done:
                before.unpersist()
            if done % KEPT == 0 and state.getCheckpointFile():
                kept.append(state.getCheckpointFile())
                for path in kept[:-1]:
                    delete(self.spark, path)
                del kept[:-1]
        state.unpersist()
        for path in kept:
            delete(self.spark, path)
        return models, found

    def _round(self, state: RDD, models: list[Boosted], may: list[np.ndarray], taken: list[list[int]], depths: list[int]) -> None:
        """One more tree of each class for every fit."""
        classes, sides = self.classes, self.folds + 1
        grown: list[list[list[np.ndarray]]] = [[[] for _ in range(classes)] for _ in models]
        for level in range(max(depths)):
            live = [i for i, d in enumerate(depths) if d > level]

            def gradients(code: Coding, level=level, live=live) -> Callable:
                def of(block: tuple) -> np.ndarray:
                    codes, n, scores = block
                    n, walk = n.reshape(len(codes), sides, classes), Boosted(code, classes, 1.0)
                    out = np.empty((len(live), classes, 2, 1 << level, code.bins))
                    for sums, i in zip(out, live):
                        p, own = shares(scores[i]), n[:, taken[i]].sum(axis=1)
                        rows = own.sum(axis=1)
                        for c in range(classes):
                            node = np.zeros(len(codes), np.int64)
                            for splits in grown[i][c]:
                                node = walk._down(codes, node, splits)
                            g, h = rows * p[:, c] - own[:, c], rows * 2 * p[:, c] * (1 - p[:, c])
                            sums[c] = bin_sums(codes, node, (g, h), 1 << level, code.bins)
                    return out
                return of

            for i, sums in zip(live, self.summed(state, gradients)):
                for c in range(classes):
                    best, leaves = models[i]._split(*sums[c], may[i])
                    grown[i][c].append(best)
                    if level == depths[i] - 1:
                        models[i].trees.append((grown[i][c], leaves))


def train_boosted_model(mart: DataFrame, k_values: Sequence[int] = (20, 30), rounds: Sequence[int] = (100, 150),
                        depths: Sequence[int] = (3, 4), rates: Sequence[float] = (0.05, 0.1), folds: int = 3,
                        seed: int = 42, max_rows: int | None = None) -> BoostedModel | None:
    """The best of all settings by the mean accuracy over stratified folds, fitted on the train side and scored on the test side.

    Split, folds and ``max_rows`` are the forest's (``model.train_outcome_model``).
    """
    frame = outcome_band(write_stage(model_frame(mart), "boost-frame")).dropna(subset=["band"])
    spark, cols = frame.sparkSession, ["id"] if "id" in frame.columns else frame.columns
    checkpoint_dir(spark)
    train, test = stratified_split(frame, "band", 0.3, seed)
    if max_rows is not None:
        train = write_stage(train.orderBy(F.xxhash64(F.lit(seed), *cols), *cols).limit(max_rows), "boost-train")
    if train.count() < MIN_ROWS * 0.7:
        return None
    code, labels = coding(train), sorted(name for _, name in BANDS)
    rows = stratified_folds(train, folds, "band", seed).unionByName(test.withColumn("fold", F.lit(-1)))
    search = Search(spark, *cells(rows, code, labels, folds), code, len(labels), folds)
    tasks = [Fit(k, d, r, f, max(rounds)) for k in k_values for d in depths for r in rates for f in range(folds)]
    _, found = search.run(tasks, rounds)
    means: dict[tuple, list[float]] = {}
    for n in rounds:
        for fit, shares_hit in zip(tasks, found[n]):
            means.setdefault((fit.k, n, fit.depth, fit.rate), []).append(shares_hit[fit.fold + 1])
    settings = sorted(((dict(zip(("k", "rounds", "depth", "rate"), s)), float(np.mean(a))) for s, a in means.items()),
                      key=lambda s: str(s[0]))
    best = max(settings, key=lambda s: s[1])[0]
    (model,), found = search.run([Fit(best["k"], best["depth"], best["rate"], None, best["rounds"])], [best["rounds"]])
    total = sum(model.gains.values()) or 1.0
    importance = sorted(((n, g / total) for n, g in model.gains.items()), key=lambda p: (-p[1], p[0]))[:10]
    (hit,), size = found[best["rounds"]], search.counts.reshape(folds + 1, -1, code.bins)[:, :, :code.starts[1]].sum(axis=(1, 2))
    return BoostedModel(model, labels, float(hit[1:] @ size[1:] / size[1:].sum()), float(hit[0]), importance, best, settings)


def score(model: BoostedModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted_band`` and ``probabilities`` (in the order of ``labels``); a level never seen matches no split."""
    own, labels = model.boosted, model.labels
    shared = df.sparkSession.sparkContext.broadcast((own.code.cuts, own.code.levels, own.classes, own.rate, own.trees))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts, levels, classes, rate, trees = shared.value
        boosted = Boosted(Coding(cuts, levels), classes, rate)
        boosted.trees = trees
        for frame in frames:
            p = shares(boosted.scores(boosted.code.codes(frame)))
            yield frame.assign(predicted_band=[labels[i] for i in p.argmax(axis=1)], probabilities=list(p))

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, predicted_band string, probabilities array<double>")


# executors need no copy of this package: what runs there is shipped by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
