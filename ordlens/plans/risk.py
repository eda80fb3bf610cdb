"""The return-risk model as an artifact: a saved pipeline and its tuned threshold (ML10, SNK5, SNK6).

``scorecard`` is the fixed-coefficient pipeline (SQL can check it);
``logistic`` and ``forest`` are fitted. A fitted pipeline with a threshold is
fitted on the training folds 1-4 and tuned on fold 0; one without is fitted on
all training rows. Tuning on the test rows, with a fit on all training rows, is
there for parity with results published that way.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..artifacts import Artifacts, snapshot
from ..functions import scoring as S
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import sampling as SM
from ..operators import stats as ST
from ..operators.features import FEATURE_ORDER, FEATURES_CATEGORICAL, FEATURES_NUMERIC
from ..sources import sinks as SK
from . import orders as PO

LR_C = 1.0
RF_TREES, RF_DEPTH = 100, 6


@dataclass(frozen=True)
class RiskModel:
    """A loaded pipeline; ``threshold`` is the one stored with it (None for a model fitted on all training rows)."""

    pipeline: PipelineModel
    threshold: float | None
    folder: str

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``p``, the return probability, to feature rows."""
        out = self.pipeline.transform(rows)
        if "p" in out.columns:
            return out
        extra = [c for c in out.columns if c not in rows.columns and c != "probability"]
        return ML.positive_probability(out).drop("probability", *extra)


def base_snapshot(spark, sf_dir) -> str:
    return snapshot(spark, sf_dir, PO.BASE_TABLES)


def prepared(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows with label, class weight ``w`` and, for train, the fold."""
    store, inputs = Artifacts(spark), base_snapshot(spark, sf_dir)
    sp = PO.split_features_table(spark, sf_dir).withColumnRenamed("returned", "label")
    train = sp.where(F.col("split") == "train")

    def make_train():
        folds = SM.stratified_folds(train.select("order_id", "label"), "label", "order_id", 5, PO.FOLD_SEED)
        return ML.with_balanced_weights(train.join(folds.select("order_id", "fold"), "order_id"), "label",
                                        ST.class_weights(train, "label"))

    fitted = store.table("risk-train", inputs, make_train, folds=5, seed=PO.FOLD_SEED)
    test = store.table("risk-test", inputs, lambda: ML.with_balanced_weights(
        sp.where(F.col("split") == "test"), "label", ST.class_weights(train, "label")), seed=PO.SPLIT_SEED)
    return fitted, test


def lr_reg(train: DataFrame) -> float:
    """Spark's regularisation for the inverse strength ``LR_C``: 1 / (C * sum of weights)."""
    return 1.0 / (LR_C * train.agg(F.sum("w")).first()[0])


def estimator(kind: str, train: DataFrame):
    return ML.logistic("label", True, lr_reg(train)) if kind == "logistic" else ML.forest("label", RF_TREES, RF_DEPTH)


def fit(kind: str, train: DataFrame) -> PipelineModel:
    """Preparation and classifier fitted on ``train``.

    The preparation's many passes read the rows where they lie. A forest, which passes over them again and again too,
    reads them spread over the cluster: shuffled once and kept while it is fitted.
    """
    prep = Pipeline(stages=ML.fit_prep_stages(train, FEATURES_NUMERIC, FEATURES_CATEGORICAL)).fit(train)
    spread = ML.spread(train, "order_id") if kind == "forest" else train
    moved = spread is not train
    rows = spread.select("label", "w", *FEATURE_ORDER).persist(StorageLevel.MEMORY_AND_DISK) if moved else train
    try:
        return PipelineModel(stages=[*prep.stages, estimator(kind, train).fit(prep.transform(rows))])
    finally:
        if moved:
            rows.unpersist()


def scorecard_pipeline(fit_risk, cod) -> PipelineModel:
    z = S.scorecard_sql(fit_risk, cod)
    return PipelineModel(stages=[SQLTransformer(
        statement=f"SELECT *, CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-{z})) AS p FROM __THIS__")])


def tuning_rows(spark, sf_dir, tune_on: str = "validation") -> DataFrame:
    """The rows on which a fitted model's threshold is chosen: ``validation`` (fold 0 of the training rows) or ``test``."""
    if tune_on not in ("validation", "test"):
        raise ValueError(f"tune_on is 'validation' or 'test', not {tune_on!r}")
    train, test = prepared(spark, sf_dir)
    return test if tune_on == "test" else train.where(F.col("fold") == 0)


def risk_model(spark, sf_dir, kind: str = "scorecard", tuned: bool = True, tune_on: str = "validation") -> RiskModel:
    """The stored model of this kind over the current tables; fitted, tuned and written only if there is none.

    ``tune_on`` as in :func:`tuning_rows`; the scorecard, which nothing is fitted for, is tuned on all rows.
    """
    cods, fits = (PO.COD, S.COD_METHOD), PO.FIT_RISK + S.FIT_RISK_CATEGORIES

    def build(folder: str) -> None:
        threshold = None
        if kind == "scorecard":
            pipeline = scorecard_pipeline(fits, cods)
            choice = PO.order_features(spark, sf_dir).withColumnRenamed("returned", "label")
        else:
            train, _ = prepared(spark, sf_dir)
            choice = tuning_rows(spark, sf_dir, tune_on)
            pipeline = fit(kind, train.where(F.col("fold") != 0) if tuned and tune_on == "validation" else train)
        if tuned:
            scored = RiskModel(pipeline, None, folder).score(choice)
            threshold = M.best_threshold(M.threshold_sweep(scored)).first()["threshold"]
        pipeline.write().save(os.path.join(folder, "pipeline"))
        SK.write_config(spark, os.path.join(folder, "config"), model=kind, threshold=-1.0 if threshold is None else threshold)

    folder = Artifacts(spark).get("risk-model", base_snapshot(spark, sf_dir), build, kind=kind, tuned=tuned, tune_on=tune_on, c=LR_C,
                                  trees=RF_TREES, depth=RF_DEPTH, seeds=(PO.SPLIT_SEED, PO.FOLD_SEED), cods=cods, fits=fits)
    threshold = spark.read.parquet(os.path.join(folder, "config")).first()["threshold"]
    return RiskModel(PipelineModel.load(os.path.join(folder, "pipeline")), None if threshold < 0 else threshold, folder)


def requested_orders(spark, sf_dir, refs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(order_ref, features) of the orders that ``refs`` (order_ref) names; all others are dropped before any scoring.

    ``extra`` are known orders outside the tables, in the same columns.
    """
    wanted = refs.where(F.col("order_ref").isNotNull()).select("order_ref").distinct()
    number = wanted.select("order_ref", F.expr("try_cast(substring(order_ref, 5) AS BIGINT)").alias("order_id")).where(
        F.col("order_ref") == F.concat(F.lit("ORD-"), F.col("order_id").cast("string")))
    found = PO.order_features(spark, sf_dir).join(number, "order_id").select("order_ref", *FEATURE_ORDER)
    return found if extra is None else found.unionByName(extra.join(wanted, "order_ref", "left_semi"))
