"""ML1 prep semantics and pipeline save/reload on a tiny table."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ordlens.operators import models as ML
from ordlens.plans import risk as RK

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [(1, 1.0, "a", 0), (2, 2.0, "b", 1), (3, None, "a", 0), (4, 10.0, None, 1), (5, 3.0, "b", 0),
            (6, 4.0, "a", 1)]
    return spark.createDataFrame(rows, "id long, x double, c string, label int")


def test_prep_imputes_scales_and_encodes(spark, tiny):
    stages = ML.fit_prep_stages(tiny, ["x"], ["c"])
    model = Pipeline(stages=stages).fit(tiny)
    new = spark.createDataFrame([(7, None, "zzz", 0), (8, 3.0, None, 1)], tiny.schema)
    out = {r.id: r.f for r in model.transform(new).select("id", vector_to_array("features").alias("f")).collect()}
    x = np.array([1, 2, 3, 10, 3, 4], dtype=float)       # null imputed with the median 3.0
    mean, std = x.mean(), x.std()                         # population std
    assert out[7][0] == pytest.approx((3.0 - mean) / std)
    assert out[7][1:] == [0.0, 0.0]                       # unseen category -> all zeros
    assert out[8][1:] == [1.0, 0.0]                       # null category -> mode 'a'


def test_logistic_save_reload_parity(spark, tiny):
    train = tiny.withColumn("w", F.lit(1.0))
    stages = ML.fit_prep_stages(train, ["x"], ["c"])
    model = Pipeline(stages=stages + [ML.logistic("label", True, 0.1)]).fit(train)
    path = os.path.join(tempfile.mkdtemp(prefix="ordlens-model-"), "m")
    again = ML.save_and_reload(model, path)
    a = ML.positive_probability(model.transform(train)).select("id", "p")
    b = ML.positive_probability(again.transform(train)).select("id", F.col("p").alias("q"))
    assert a.join(b, "id").agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] == 0.0


def test_rows_that_choose_a_threshold(spark):
    """Validation: fold 0 of the training rows, none of them a test row; test: the test rows; nothing else."""
    train, test = RK.prepared(spark, SF)
    val, on_test = RK.tuning_rows(spark, SF), RK.tuning_rows(spark, SF, "test")
    assert val.count() == train.where("fold = 0").count() > 0
    assert val.join(test, "order_id", "left_semi").isEmpty() and on_test.join(test, "order_id", "left_anti").isEmpty()
    with pytest.raises(ValueError):
        RK.tuning_rows(spark, SF, "train")
