"""ML1-ML9: multiclass outcome-band model with Spark ML.

Same features, labels, selection, split rule and reported metrics as the
reference; a RandomForest replaces boosted trees (Spark's GBT is binary only
and ``OneVsRest`` of it gives no probabilities), so results differ from the
reference's model.  Training, cross-validation and scoring run as Spark jobs;
only the fitted model's small summaries reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (OneHotEncoder, StandardScaler, StringIndexer, UnivariateFeatureSelector,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caremart.functions.pvalues import f_pvalue
from caremart.functions.quantiles import exact_quantiles
from caremart.plans.materialize import write_stage
from caremart.plans.scorer import CompiledForest

NUMERIC = ["cost_per_session", "session_duration", "quality_rating"]
CATEGORICAL = ["intervention_name", "intervention_category", "metric_name", "age_group", "disability_category",
               "support_level"]
# Outcome bands of the normalised score, right-closed (-1, 4], (4, 7], (7, 11].
BANDS = [(4.0, "Low"), (7.0, "Medium"), (11.0, "High")]
BAND_FLOOR = -1.0
MIN_ROWS = 100


def model_frame(mart: DataFrame) -> DataFrame:
    """ML1/FLT11: the modelling columns, rows with a normalised score only."""
    ids = ["id"] if "id" in mart.columns else []
    return mart.select(*ids, *NUMERIC, *CATEGORICAL, "score", "normalized_score").dropna(subset=["normalized_score"])


def outcome_band(df: DataFrame, col: str = "normalized_score", out: str = "band") -> DataFrame:
    """ML2: Low / Medium / High band (right-closed bins; outside (-1, 11] is NULL)."""
    c = F.col(col)
    band = F.when(c <= BAND_FLOOR, F.lit(None).cast("string"))
    for hi, name in BANDS:
        band = band.when(c <= hi, name)
    return df.withColumn(out, band)


def draw(df: DataFrame, seed: int = 42, label: str = "band", key: Sequence[str] | None = None) -> Column:
    """The number that each row draws: a seeded hash of its key (``id``, else all columns but the label)."""
    cols = list(key) if key else ["id"] if "id" in df.columns else [c for c in df.columns if c != label]
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(1 << 52)).cast("double")


def _cut(df: DataFrame, label: str, number: Column, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``df`` with the drawn number as ``_u`` and the exact quantiles of its label's numbers.

    The passes over the numbers scan them as written, not what ``df`` derives from.
    """
    marked = df.withColumn("_u", number)
    numbers = write_stage(marked.select(label, "_u"), "draws")
    return marked.join(exact_quantiles(numbers, [label], "_u", probs, names), label)  # one row per label


def stratified_split(df: DataFrame, label: str = "band", test_fraction: float = 0.3, seed: int = 42,
                     key: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """ML4: reproducible split with ``test_fraction`` of every label, to one row, in the test side.

    Each row draws a number (``draw``); the exact quantile of these numbers within each
    label is the cut, so no label's rows are sorted in one task.
    """
    marked = _cut(df, label, draw(df, seed, label, key), [test_fraction], ["_cut"])
    return (marked.where(F.col("_u") >= F.col("_cut")).drop("_u", "_cut").select(*df.columns),
            marked.where(F.col("_u") < F.col("_cut")).drop("_u", "_cut").select(*df.columns))


def stratified_folds(df: DataFrame, folds: int = 3, label: str = "band", seed: int = 42, out: str = "fold",
                     key: Sequence[str] | None = None, drawn: str | None = None) -> DataFrame:
    """ML4/ML5: adds fold numbers from 0; every label's folds differ by one row at most.

    The cuts between folds are exact quantiles of the numbers drawn under the next seed
    within each label, so no label is sorted in one task.  ``drawn`` names a column that
    holds these numbers already (``draw`` with ``seed + 1``).
    """
    names = [f"_cut{i}" for i in range(1, folds)]
    number = F.col(drawn) if drawn else draw(df, seed + 1, label, key)
    marked = _cut(df, label, number, [i / folds for i in range(1, folds)], names)
    above = sum(((F.col("_u") >= F.col(c)).cast("int") for c in names), F.lit(0))
    return marked.select(*df.columns, above.alias(out))


def anova_scores(df: DataFrame, label: str = "band", numeric: Sequence[str] = NUMERIC,
                 categorical: Sequence[str] = CATEGORICAL) -> DataFrame:
    """ML5: ``feature, f_score, p_value`` of every numeric column and every level but the first of each categorical.

    The F statistic of each feature between the labels, from its count, sum and sum of
    squares in each label: one pass of partial sums for the numeric columns, one for the
    levels, and a few rows for each feature after that.  A constant feature has no score.
    """
    rows = df.where(F.col(label).isNotNull())
    per_label = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"), *[
        a for c in numeric for a in (F.count(c).alias(f"_c_{c}"), F.sum(F.col(c).cast("double")).alias(f"_s_{c}"),
                                     F.sum(F.pow(F.col(c).cast("double"), F.lit(2.0))).alias(f"_q_{c}"))])
    per_label = write_stage(per_label, "anova-labels")  # one row for each label
    sums = per_label.select("_label", F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"_c_{c}").alias("c"), F.col(f"_s_{c}").alias("s"), F.col(f"_q_{c}").alias("q"))
        for c in numeric])).alias("v")).select("_label", "v.*")
    levels = rows.select(F.col(label).alias("_label"), F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in categorical])).alias("v"))
    levels = write_stage(levels.select("_label", "v.*").where(F.col("level").isNotNull())
                         .groupBy("column", "level", "_label").agg(F.count(F.lit(1)).alias("one")), "anova-levels")
    first = levels.groupBy("column").agg(F.min("level").alias("_first"))
    used = levels.join(first, "column").where(F.col("level") != F.col("_first"))
    names = used.select("column", "level").distinct()
    # a label without the level has a sum of 0; one row for each label meets every level
    grid = names.crossJoin(F.broadcast(per_label.select("_label", F.col("_n").alias("c"))))
    ones = grid.join(used.select("column", "level", "_label", "one"), ["column", "level", "_label"], "left").select(
        "_label", F.concat_ws("_", "column", "level").alias("feature"), "c",
        F.coalesce(F.col("one"), F.lit(0)).cast("double").alias("s"), F.coalesce(F.col("one"), F.lit(0)).cast("double").alias("q"))
    each = sums.unionByName(ones).where(F.col("c") > 0)
    total = each.groupBy("feature").agg(
        F.count(F.lit(1)).alias("_k"), F.sum("c").cast("double").alias("_n"), F.sum("s").alias("_s"), F.sum("q").alias("_q"),
        F.sum(F.col("s") * F.col("s") / F.col("c")).alias("_b"))
    between = (F.col("_b") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_k") - 1)
    within = (F.col("_q") - F.col("_b")) / (F.col("_n") - F.col("_k"))
    spread = F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n") > 1e-12 * F.col("_q")
    total = total.withColumn("f_score", F.when(spread & (F.col("_k") > 1), F.try_divide(between, within))).withColumn(
        "_within", F.col("_n") - F.col("_k"))
    p = F.lit(None).cast("double")
    for k in range(2, len(BANDS) + 1):
        p = F.when(F.col("_k") == k, f_pvalue(F.col("f_score"), k - 1, F.col("_within"))).otherwise(p)
    return total.select("feature", "f_score", p.alias("p_value"))


def k_best(scores: DataFrame, k: int = 20) -> DataFrame:
    """ML5: the scores with ``chosen``, the ``k`` features of the greatest F (ties by name); one row for each feature."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("f_score"), "feature"))
    return scores.withColumn("chosen", (place <= k) & F.col("f_score").isNotNull())


def feature_stages(categorical: Sequence[str] = CATEGORICAL, numeric: Sequence[str] = NUMERIC) -> list:
    """ML3: one-hot of each categorical dropping its alphabetically first level, plus numerics."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetDesc", handleInvalid="error")
           for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_ohe" for c in categorical],
                        dropLast=True)
    asm = VectorAssembler(inputCols=list(numeric) + [f"{c}_ohe" for c in categorical], outputCol="raw_features",
                          handleInvalid="keep")
    return [*idx, ohe, asm]


@dataclass
class OutcomeModel:
    model: PipelineModel
    train_accuracy: float
    test_accuracy: float
    feature_importance: list[tuple[str, float]]
    labels: list[str]
    best_params: dict
    defaults: dict


def train_outcome_model(mart: DataFrame, k_values: Sequence[int] = (20, 30), trees: Sequence[int] = (100, 150),
                        depths: Sequence[int] = (3, 4), folds: int = 3, seed: int = 42,
                        parallelism: int = 4, max_rows: int | None = None) -> OutcomeModel | None:
    """ML5-ML7: select k best (ANOVA F), scale, random forest; grid search by stratified 3-fold CV on accuracy.

    All labelled rows are split, and the fit takes the whole train side; a caller may
    bound it to ``max_rows`` rows, those first by a hash of the row.  The accuracies are
    over the train side and the whole test side.  ``defaults`` of the model are the first
    values (by id) of the rows it was fitted on.  Labels, levels and one-hot columns do
    not depend on the folds: they are found once.
    """
    frame = outcome_band(write_stage(model_frame(mart), "model-frame")).dropna(subset=["band"])
    cols = ["id"] if "id" in frame.columns else frame.columns
    train, test = stratified_split(frame, "band", 0.3, seed)
    if max_rows is not None:
        train = write_stage(train.orderBy(F.xxhash64(F.lit(seed), *cols), *cols).limit(max_rows), "model-train")
    rows = train.count()
    if rows < MIN_ROWS * 0.7:
        return None
    train = write_stage(stratified_folds(train, folds, "band", seed), "model-folds")
    first = train.orderBy(*cols).first()
    label_idx = StringIndexer(inputCol="band", outputCol="label", stringOrderType="alphabetAsc")
    prefix = Pipeline(stages=[label_idx, *feature_stages()]).fit(train)
    ready = write_stage(prefix.transform(train).select("label", "raw_features", "fold"), "model-ready")
    selector = UnivariateFeatureSelector(featuresCol="raw_features", outputCol="selected", labelCol="label",
                                         selectionMode="numTopFeatures")
    selector.setFeatureType("continuous").setLabelType("categorical")
    scaler = StandardScaler(inputCol="selected", outputCol="features", withMean=True, withStd=True)
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed, maxBins=split_bins(rows))
    pipe = Pipeline(stages=[selector, scaler, rf])
    grid = (ParamGridBuilder().addGrid(selector.selectionThreshold, [float(k) for k in k_values])
            .addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths)).build())
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, foldCol="fold",
                        parallelism=parallelism)
    fitted = cv.fit(ready).bestModel
    best = PipelineModel(stages=[*prefix.stages, *fitted.stages])
    tr_acc, te_acc = ev.evaluate(fitted.transform(ready)), ev.evaluate(best.transform(test))
    return OutcomeModel(best, tr_acc, te_acc, feature_importance(best, train), list(best.stages[0].labels),
                        {"k": best.stages[-3].getSelectionThreshold(), "numTrees": best.stages[-1].getNumTrees,
                         "maxDepth": best.stages[-1].getOrDefault("maxDepth")},
                        {c: first[c] for c in (*NUMERIC, *CATEGORICAL)})


def split_bins(rows: int) -> int:
    """``maxBins`` with which Spark takes a forest's split candidates from all rows: it samples beyond its square (and 10,000)."""
    return 32 if rows <= 10_000 else math.isqrt(rows - 1) + 1


def feature_importance(model: PipelineModel, sample: DataFrame, top: int = 10) -> list[tuple[str, float]]:
    """ML7: the top feature importances, named by the assembled attribute names of the selected slots."""
    prefix = PipelineModel(stages=model.stages[:-3])
    meta = prefix.transform(sample.limit(1)).schema["raw_features"].metadata.get("ml_attr", {})
    names = {}
    for group in meta.get("attrs", {}).values():
        for a in group:
            names[a["idx"]] = a["name"]
    selected = sorted(model.stages[-3].selectedFeatures)  # the selector keeps the order of the features
    imp = model.stages[-1].featureImportances.toArray()
    pairs = [(names.get(selected[i], f"f{selected[i]}"), float(v)) for i, v in enumerate(imp)]
    return sorted(pairs, key=lambda p: (-p[1], p[0]))[:top]


def compiled(model: OutcomeModel) -> CompiledForest:
    """ML8/ML9: the fitted model as plain column expressions and SQL (``plans.scorer``)."""
    return CompiledForest.of(model.model, NUMERIC, CATEGORICAL, model.defaults)


def predict(model: OutcomeModel, df: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """ML8/ML9: class and per-class probabilities for new sessions.

    Missing inputs and categorical values the model never saw take ``defaults``, else
    the first values of the training rows, as the reference does.
    """
    defaults = model.defaults | dict(defaults or {})
    out = df
    for c in NUMERIC:
        v = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        out = out.withColumn(c, F.coalesce(v, F.lit(float(defaults.get(c) or 0.0))))
    indexers = [s for s in model.model.stages if isinstance(s, type(model.model.stages[1]))][1:]
    for c, ix in zip(CATEGORICAL, indexers):
        labels = list(ix.labels)
        base = defaults.get(c) if defaults.get(c) in labels else min(labels)
        v = F.col(c).cast("string") if c in df.columns else F.lit(base)
        out = out.withColumn(c, F.when(v.isin(labels), v).otherwise(F.lit(base)))
    scored = model.model.transform(out.withColumn("band", F.lit(model.labels[0])))
    lab = F.array(*[F.lit(x) for x in model.labels])
    return scored.withColumns({"predicted_band": lab[F.col("prediction").cast("int")],
                               "probabilities": vector_to_array(F.col("probability"))})
