"""Spark ML pipelines for the return-risk model and the embedding softmax head.

Preparation (ML1) is fitted on training rows only with exact statistics
(see :mod:`.stats`) and frozen into the pipeline as a ``SQLTransformer``
holding the constants, so a saved ``PipelineModel`` reproduces it exactly:

    impute (median / mode) -> scale numerics with population std ->
    StringIndexer(alphabetAsc, keep) -> OneHotEncoder(dropLast) ->
    VectorAssembler -> classifier

``handleInvalid="keep"`` + ``dropLast=True`` keeps every known category and
maps unseen (and null) values to all zeros, as the reference's encoder does.
"""

from __future__ import annotations

import math
import threading

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats as ST


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(float(v))


def fit_prep_stages(train: DataFrame, numeric, categorical) -> list:
    """ML1 stages with statistics fitted on ``train`` only."""
    med = ST.exact_medians(train, numeric)
    imputed = {c: F.coalesce(ST.present(c), F.lit(med[c])) for c in numeric}
    mom = train.agg(*[F.avg(e).alias(f"m_{i}") for i, e in enumerate(imputed.values())],
                    *[F.stddev_pop(e).alias(f"s_{i}") for i, e in enumerate(imputed.values())]).first()
    modes = {r["column"]: r["mode"] for r in ST.modes(train, categorical).collect()}
    exprs = []
    for i, c in enumerate(numeric):
        std = mom[f"s_{i}"] or 1.0
        exprs.append(f"(coalesce(nullif(CAST({c} AS DOUBLE), double('NaN')), {_sql_literal(med[c])}) - {_sql_literal(mom[f'm_{i}'])})"
                     f" / {_sql_literal(std)} AS {c}__s")
    for c in categorical:
        exprs.append(f"coalesce({c}, {_sql_literal(modes.get(c))}) AS {c}__f")
    sql = SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__")
    idx = StringIndexer(inputCols=[f"{c}__f" for c in categorical], outputCols=[f"{c}__i" for c in categorical],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    # the indexer's extra "unknown" index is the last category, so dropLast
    # drops exactly it: unseen and null values encode to all zeros
    ohe = OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__v" for c in categorical],
                        dropLast=True)
    asm = VectorAssembler(inputCols=[f"{c}__s" for c in numeric] + [f"{c}__v" for c in categorical],
                          outputCol="features")
    return [sql, idx, ohe, asm]


def with_balanced_weights(df: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """AGG8 weights (``label, weight`` rows, one per class) as a column."""
    return df.join(F.broadcast(weights.select(label, F.col("weight").alias("w"))), label)


def logistic(label: str = "label", weighted: bool = True, reg_param: float = 0.0) -> LogisticRegression:
    """ML2: L2 logistic regression; ``reg_param = 1/(C * sum of weights)`` gives
    the C-parameterised objective."""
    lr = LogisticRegression(labelCol=label, featuresCol="features", regParam=reg_param, elasticNetParam=0.0,
                            standardization=False, maxIter=1000, tol=1e-6)
    if weighted:
        lr.setWeightCol("w")
    return lr


def forest(label: str = "label", trees: int = 100, depth: int = 6, seed: int = 42) -> RandomForestClassifier:
    """ML3: gini forest, sqrt features per split, class weights."""
    return RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="w", numTrees=trees,
                                  maxDepth=depth, impurity="gini", featureSubsetStrategy="sqrt", seed=seed)


#: Training rows in one partition of a forest's fit: each is kept as its bins and its draws by every tree.
FIT_ROWS = 500_000
#: Points of a grid are fitted side by side up to so many rows; beyond, one fit fills the cluster and its memory.
SIDE_BY_SIDE_ROWS = 2_000_000
#: Bytes of the driver's heap for a node of the forests that are fitted side by side: it holds them all.
NODE_BYTES = 1024


def spread(train: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """``train`` in partitions of about ``FIT_ROWS`` rows (``rows``); left as it is when it has as many partitions already."""
    parts = math.ceil(train.count() / (rows or FIT_ROWS))
    return train.repartition(parts, key) if parts > train.rdd.getNumPartitions() else train


def positive_probability(model_out: DataFrame, out: str = "p") -> DataFrame:
    """ML5: P(class 1) from the probability vector."""
    return model_out.withColumn(out, vector_to_array("probability")[1])


class PreparedEstimator(Estimator):
    """Preparation and a classifier as one estimator: every fit learns its own statistics (ML4).

    In a cross-validation the preparation is therefore fitted on the training
    part of each fold, once for all points of the grid. The model is a
    ``PipelineModel`` of plain stages, so it is saved and loaded as such.
    """

    def __init__(self, classifier: Estimator, numeric, categorical):
        super().__init__()
        self.classifier, self.numeric, self.categorical = classifier, list(numeric), list(categorical)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.classifier = self.classifier.copy(extra)
        return that

    def _prepare(self, dataset: DataFrame) -> PipelineModel:
        return Pipeline(stages=fit_prep_stages(dataset, self.numeric, self.categorical)).fit(dataset)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        prep = self._prepare(dataset)
        return PipelineModel(stages=[*prep.stages, self.classifier.fit(prep.transform(dataset))])

    def fitMultiple(self, dataset, paramMaps):  # noqa: N802
        prep = self._prepare(dataset)
        ready = prep.transform(dataset)
        return _Fits(lambda i: PipelineModel(stages=[*prep.stages, self.classifier.fit(ready, paramMaps[i])]), len(paramMaps))


class _Fits:
    """(index, model) for each point of a grid; threads may draw from it at once."""

    def __init__(self, fit, n: int):
        self.fit, self.numbers, self.lock = fit, iter(range(n)), threading.Lock()

    def __iter__(self):
        return self

    def __next__(self):
        with self.lock:
            i = next(self.numbers)
        return i, self.fit(i)


def cross_validate(estimator: PreparedEstimator, train_with_fold: DataFrame, grid: dict, label: str, parallelism: int | None = None,
                   num_folds: int = 5):
    """ML4: grid search on a fixed fold column (exact stratified folds), AUC,
    refit of the best point (the first of equals) on all training rows.

    ``parallelism``: points fitted at once; without it 4, or fewer when there
    are so many rows, or so large forests, that the fits would push each other
    out of memory.
    """
    if parallelism is None:
        n = train_with_fold.count()
        trees, depth = (max(grid.get(p, [estimator.classifier.getOrDefault(p)])) for p in ("numTrees", "maxDepth"))
        heap = train_with_fold.sparkSession.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
        at_once = heap // (NODE_BYTES * trees * min(2 ** (depth + 1), max(n, 1)))
        parallelism = max(1, min(4, at_once)) if n <= SIDE_BY_SIDE_ROWS else 1
    pg = ParamGridBuilder()
    for param, values in grid.items():
        pg = pg.addGrid(getattr(estimator.classifier, param), values)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=pg.build(),
                        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0),
                        foldCol="fold", numFolds=num_folds, parallelism=parallelism, seed=42)
    return cv.fit(train_with_fold)


def gradient(scored: DataFrame, residuals: list, weight=None, features: str = "features") -> list[list[float]]:
    """Per residual column: the weighted mean of residual x (features, 1), the data part of a linear model's gradient.

    One aggregation; a row adds one vector of all residuals' products.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    x = F.concat(vector_to_array(features), F.array(F.lit(1.0)))
    scaled = lambda by: F.transform(x, lambda v: v * by)
    parts = [scaled(r * w) for r in residuals]
    sums, total, width = scored.select(array_to_vector(F.concat(*parts)).alias("v"), w.alias("w"), F.size(x).alias("n")).agg(
        Summarizer.sum(F.col("v")), F.sum("w"), F.max("n")).first()
    flat = [v / total for v in sums.toArray().tolist()]
    return [flat[i : i + width] for i in range(0, len(flat), width)]


def encoded_names(scored: DataFrame) -> list[str]:
    """Names of each slot of the ``features`` vector from its ML attributes."""
    meta = scored.schema["features"].metadata["ml_attr"]["attrs"]
    slots = []
    for kind in ("numeric", "binary", "nominal"):
        for a in meta.get(kind, []):
            slots.append((a["idx"], a["name"]))
    return [n for _, n in sorted(slots)]


def source_column(name: str, raw_columns) -> str:
    """ML7: encoded slot name -> raw column (longest raw-name prefix)."""
    best = None
    for c in raw_columns:
        if name == c or name.startswith(c + "__"):
            if best is None or len(c) > len(best):
                best = c
    return best or name


def save_and_reload(model: PipelineModel, path: str) -> PipelineModel:
    """SNK5: overwrite-save then load."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def softmax_head(reg_param: float, max_iter: int) -> LogisticRegression:
    """ML13: multinomial linear head (same model class as a linear layer +
    cross-entropy; a different solver)."""
    return LogisticRegression(featuresCol="features", labelCol="label", family="multinomial",
                              regParam=reg_param, elasticNetParam=0.0, standardization=False, maxIter=max_iter)
