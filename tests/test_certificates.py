"""Grid search with preparation inside the folds, gradients, tree tables, AUC of crowded scores."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ordlens.operators import metrics as M
from ordlens.operators import models as ML
from ordlens.operators import trees as TR


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = [(i, r.gauss(0, 1) + (10 if i % 3 == 0 else 0), r.choice("abc"), i % 3) for i in range(240)]
    data = [(i, x, c, f, int(x + (c == "a") + r.gauss(0, 2) > 3), 1.0 + (i % 2)) for i, x, c, f in data]
    return spark.createDataFrame(data, "id long, x double, c string, fold int, label int, w double")


def test_every_fold_has_its_own_statistics_and_the_first_best_wins(spark, rows, tmp_path, monkeypatch):
    fitted = []
    inner = ML.fit_prep_stages

    def seen(train, numeric, categorical):
        stages = inner(train, numeric, categorical)
        fitted.append((train.count(), stages[0].getStatement()))
        return stages

    monkeypatch.setattr(ML, "fit_prep_stages", seen)
    est = ML.PreparedEstimator(ML.forest("label", trees=3, depth=2), ["x"], ["c"])
    cvm = ML.cross_validate(est, rows, {"numTrees": [3, 3], "maxDepth": [2]}, "label", parallelism=2, num_folds=3)
    assert sorted(n for n, _ in fitted) == [160, 160, 160, 240]  # once per fold, whatever the grid, and for the refit
    assert len({statement for _, statement in fitted}) == 4  # no fold shares the statistics of another or of all rows
    assert cvm.avgMetrics[0] == cvm.avgMetrics[1]  # equal points: the first one is refitted
    assert cvm.bestModel.stages[-1].getNumTrees == 3
    cvm.bestModel.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b = (ML.positive_probability(m.transform(rows)).select("id", "p").collect() for m in (cvm.bestModel, again))
    assert sorted(a) == sorted(b)


def test_gradient_is_zero_at_the_optimum_only(spark, rows):
    model = ML.PreparedEstimator(ML.logistic("label", True, 0.1), ["x"], ["c"]).fit(rows)
    out = ML.positive_probability(model.transform(rows))
    lr = model.stages[-1]
    b = [*lr.coefficients.toArray().tolist(), 0.0]
    at = ML.gradient(out, [F.col("p") - F.col("label"), F.lit(1.0)], "w")
    assert max(abs(g + 0.1 * c) for g, c in zip(at[0], b)) < 1e-5
    assert at[1][-1] == pytest.approx(1.0)  # the weighted mean of 1
    off = ML.gradient(out.withColumn("p", F.col("p") + 0.01), [F.col("p") - F.col("label")], "w")[0]
    assert abs(off[-1]) > 5e-3


def test_tree_table_scores_and_importances(spark, rows, tmp_path):
    model = ML.PreparedEstimator(ML.forest("label", trees=7, depth=4), ["x"], ["c"]).fit(rows)
    model.write().save(str(tmp_path / "m"))
    nodes = TR.forest_nodes(spark, str(tmp_path / "m"))
    out = ML.positive_probability(model.transform(rows))
    got = {r.id: r.p for r in TR.forest_probability(out, nodes, 4, "id").collect()}
    assert len(got) == 240 and all(abs(got[r.id] - r.p) < 1e-12 for r in out.select("id", "p").collect())
    theirs = model.stages[-1].featureImportances.toArray()
    own = dict(TR.forest_importances(nodes).collect())
    assert all(abs(own.get(i, 0.0) - v) < 1e-9 for i, v in enumerate(theirs))


def test_auc_of_crowded_scores_is_exact_and_spread(spark, monkeypatch):
    r = random.Random(9)
    data = [(0.5 + r.randrange(4000) * 2.5e-9, int(r.random() < 0.4)) for _ in range(6000)]
    df = spark.createDataFrame(data, "p double, label int")
    tables = []
    write = M.materialize
    monkeypatch.setattr(M, "materialize", lambda d, name: tables.append(write(d, name)) or tables[-1])
    got = M.auc_counts(df, n_buckets=8).first()
    per = {x["_bk"]: x["count"] for x in tables[0].groupBy("_bk").count().collect()}
    assert len(per) >= 6 and max(per.values()) < sum(per.values()) / 3
    pos, neg = [p for p, y in data if y], [p for p, y in data if not y]
    ranks = {}
    for p in neg:
        ranks[p] = ranks.get(p, 0) + 1
    below, at = 0, {}
    for p in sorted({p for p, _ in data}):
        at[p] = 2 * below + ranks.get(p, 0)
        below += ranks.get(p, 0)
    assert (got.n_pos, got.n_neg, got.num2) == (len(pos), len(neg), sum(at[p] for p in pos))
