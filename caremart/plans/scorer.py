"""ML8/ML9: a fitted outcome model as plain expressions, for DataFrames and for SQL.

The fitted pipeline (one-hot, selection, scaling, forest) becomes a column expression over the raw columns: the scaled
features, and for every tree one nested ``CASE`` of its leaves' class shares.  So any number of rows is scored inside one
projection, without the ML pipeline's vectors, and the same model runs as SQL in another engine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Node = tuple  # ("leaf", shares) or ("split", feature, threshold, low, high)


@dataclass
class Feature:
    """A scaled feature: a numeric column, or whether a column has a level."""
    column: str
    level: str | None
    mean: float
    scale: float

    def expression(self) -> Column:
        raw = F.col(self.column).cast("double") if self.level is None else F.when(
            F.col(self.column) == self.level, 1.0).otherwise(0.0)
        return (raw - self.mean) * self.scale

    def sql(self) -> str:
        level = (self.level or "").replace("'", "''")
        raw = (f"CAST({self.column} AS DOUBLE)" if self.level is None
               else f"CASE WHEN {self.column} = '{level}' THEN 1.0 ELSE 0.0 END")
        return f"(({raw})::DOUBLE - {self.mean!r}::DOUBLE) * {self.scale!r}::DOUBLE"


def _node(node) -> Node:
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        total = sum(stats)
        return ("leaf", [x / total if total else 0.0 for x in stats])
    split = node.split()
    return ("split", split.featureIndex(), split.threshold(), _node(node.leftChild()), _node(node.rightChild()))


@dataclass
class CompiledForest:
    features: list[Feature]
    trees: list[Node]
    labels: list[str]
    defaults: dict

    @classmethod
    def of(cls, model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str], defaults: Mapping | None = None
           ) -> CompiledForest:
        """Of a fitted pipeline: label and column indexers, one-hot, assembler, selector, scaler, forest."""
        indexers = model.stages[1:1 + len(categorical)]
        selector, scaler, forest = model.stages[-3:]
        # the one-hot encoder drops each indexer's last label
        raw = [(c, None) for c in numeric] + [(c, v) for c, ix in zip(categorical, indexers) for v in ix.labels[:-1]]
        mean, std = scaler.mean.toArray(), scaler.std.toArray()
        features = [Feature(*raw[slot], float(m), 1 / float(s) if s else 0.0)
                    for slot, m, s in zip(sorted(selector.selectedFeatures), mean, std)]
        return cls(features, [_node(t._call_java("rootNode")) for t in forest.trees], list(model.stages[0].labels),
                   dict(defaults or {}))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``probabilities`` (in the order of ``labels``) and ``predicted_band``.

        Inputs that are missing, as columns or as values, take ``defaults``; a level that the model never saw has no
        one-hot column, as in the reference's prediction form.
        """
        used = dict.fromkeys(f.column for f in self.features)
        filled = {c: F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(self.defaults.get(c))) for c in used}
        rows = df.select("*", F.struct(*[v.alias(c) for c, v in filled.items()]).alias("_in"))
        rows = rows.withColumn("_x", F.array(*[f.expression() for f in self._inside("_in")]))

        def tree(node: Node) -> Column:
            if node[0] == "leaf":
                return F.array(*map(F.lit, node[1]))
            return F.when(F.get("_x", F.lit(node[1])) <= node[2], tree(node[3])).otherwise(tree(node[4]))

        zero = F.array(*[F.lit(0.0)] * len(self.labels))
        votes = F.aggregate(F.array(*map(tree, self.trees)), zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        rows = rows.withColumn("_votes", votes).withColumn("_sum", F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x))
        rows = rows.withColumn("probabilities", F.transform("_votes", lambda v: v / F.col("_sum")))
        best = F.array_position("_votes", F.array_max("_votes")).cast("int")
        return rows.withColumn("predicted_band", F.element_at(F.array(*map(F.lit, self.labels)), best)).drop(
            "_in", "_x", "_votes", "_sum")

    def _inside(self, struct: str) -> list[Feature]:
        return [Feature(f"{struct}.{f.column}", f.level, f.mean, f.scale) for f in self.features]

    def sql(self, table: str, keep: Sequence[str]) -> str:
        """The same scores of a table whose input columns have no nulls, as SQL (DuckDB)."""
        def tree(node: Node) -> str:
            if node[0] == "leaf":
                return "[" + ", ".join(f"{x!r}::DOUBLE" for x in node[1]) + "]"
            return f"CASE WHEN x{node[1]} <= {node[2]!r}::DOUBLE THEN {tree(node[3])} ELSE {tree(node[4])} END"

        inputs = ", ".join(f"{f.sql()} AS x{i}" for i, f in enumerate(self.features))
        trees = ", ".join(f"{tree(t)} AS t{i}" for i, t in enumerate(self.trees))
        sums = ", ".join(" + ".join(f"t{i}[{k + 1}]" for i in range(len(self.trees))) for k in range(len(self.labels)))
        labels = ", ".join("'" + x.replace("'", "''") + "'" for x in self.labels)
        kept = ", ".join(keep)
        return (f"SELECT {kept}, list_transform(votes, lambda v: v / list_sum(votes)) AS probabilities, "
                f"([{labels}])[list_position(votes, list_max(votes))] AS predicted_band FROM (SELECT {kept}, [{sums}] AS votes "
                f"FROM (SELECT {kept}, {trees} FROM (SELECT {kept}, {inputs} FROM {table}) f) t) v")
