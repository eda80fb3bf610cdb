"""Artifacts: built once, switched atomically, rebuilt for a changed input; risk tool on a loaded model."""

import pytest

from ordlens.artifacts import Artifacts, snapshot
from ordlens.operators import routing as RT
from ordlens.sources import sinks as SK


def test_a_killed_build_leaves_the_old_version(spark, tmp_path):
    store, built = Artifacts(spark, str(tmp_path)), []

    def build(n, fail=False):
        def run(folder):
            built.append(n)
            spark.range(n).write.parquet(folder)
            if fail:
                raise KeyboardInterrupt  # the process dies after all rows are written, before the switch

        return run

    assert store.path("index") is None
    first = store.get("index", "files-1", build(3), dim=8)
    assert store.get("index", "files-1", build(3), dim=8) == first and built == [3]
    with pytest.raises(KeyboardInterrupt):
        store.get("index", "files-2", build(5, fail=True), dim=8)
    assert store.path("index") == first and spark.read.parquet(store.path("index")).count() == 3
    second = store.get("index", "files-2", build(5), dim=8)  # a changed input
    assert store.path("index") == second != first and spark.read.parquet(second).count() == 5
    assert store.get("index", "files-2", build(6), dim=9) not in (first, second)  # a changed parameter
    assert spark.read.parquet(first).count() == 3 and built == [3, 5, 5, 6]


def test_snapshot_follows_the_files(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    one = snapshot(spark, str(tmp_path), ["a"])
    assert snapshot(spark, str(tmp_path), ["a"]) == one
    spark.range(1).write.mode("append").parquet(str(tmp_path / "a.parquet"))
    assert snapshot(spark, str(tmp_path), ["a"]) != one


def test_metrics_of_a_repeated_run_are_there_once(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = lambda run, x: spark.createDataFrame([(run, "auc", x), (run, "f1", 0.5)], "run_id string, metric string, value double")
    for run, x in (("a", 0.1), ("b", 0.2), ("a", 0.3)):
        SK.append_metrics(rows(run, x), path)
    got = {(r.run_id, r.metric): r.value for r in spark.read.parquet(path).collect()}
    assert got == {("a", "auc"): 0.3, ("a", "f1"): 0.5, ("b", "auc"): 0.2, ("b", "f1"): 0.5}
    assert spark.read.parquet(path).count() == 4


def test_fitted_risk_model_is_loaded_with_its_threshold(spark, monkeypatch):
    from conftest import SF_SMALL
    from ordlens.plans import risk as RK
    from ordlens.plans import routing as PR

    model = RK.risk_model(spark, SF_SMALL, "logistic")
    fits = []
    monkeypatch.setattr(RK, "fit", lambda *a: fits.append(a))
    again = RK.risk_model(spark, SF_SMALL, "logistic")
    assert not fits and again.folder == model.folder and again.threshold == model.threshold and 0.1 <= model.threshold <= 0.9
    refs = [r.order_id for r in RK.prepared(spark, SF_SMALL)[1].limit(3).collect()]
    asked = spark.createDataFrame([(i, 0, f"ORD-{o}") for i, o in enumerate([*refs, 10**12])] + [
        (8, 0, "ORD-007"), (9, 0, None), (10, 0, "ORD-DEMO-002"), (11, 0, "ORD-" + "9" * 30)], "conv_id long, turn long, carried_order_ref string")
    known = RK.requested_orders(spark, SF_SMALL, asked.withColumnRenamed("carried_order_ref", "order_ref"), PR.demo_orders(spark))
    assert sorted(r.order_ref for r in known.collect()) == sorted([f"ORD-{o}" for o in refs] + ["ORD-DEMO-002"])
    got = {r.conv_id: r.resp for r in PR.risk_answers(spark, SF_SMALL, asked, model).collect()}
    p = {r.order_id: r.p for r in model.score(RK.prepared(spark, SF_SMALL)[1]).collect()}
    for i, o in enumerate(refs):
        want = "Low" if p[o] < model.threshold else "Medium" if p[o] < model.threshold + 0.15 else "High"
        assert f"%.4f, giving this order a {want}" % round(p[o], 4) in got[i].answer
        assert got[i].answer.endswith("t*_rf = %.4f." % model.threshold)
    assert all(got[i].confidence == 0.0 and got[i].answer == PR.TX.ORDER_REQUIRED for i in (3, 8, 9, 11)) and got[10].confidence > 0


def test_unknown_intent_and_default_image(spark):
    from conftest import SF_SMALL
    from ordlens.plans import routing as PR

    r = spark.createDataFrame([(1, 0, "x", "refund", None, None), (2, 0, "x", None, None, None), (3, 0, "x", "product_category", None, None),
                               (4, 0, "x", "product_category", None, 0), (5, 0, "x", "product_category", None, -5), (None, None, "x", "blocked", None, None)],
                              "conv_id long, turn long, query string, intent string, carried_order_ref string, image_id long")
    got = {x.conv_id: x for x in PR.respond(spark, SF_SMALL, r, *PR.tools(spark, SF_SMALL)).collect()}
    assert all(got[i].answer == PR.TX.UNKNOWN and got[i].confidence == 0.0 and got[i].source == "policy_kb" for i in (1, 2))
    assert got[3].answer == got[4].answer and got[4].answer.startswith("The product is classified as")
    assert got[5].answer == PR.TX.NO_IMAGE and got[None].answer == PR.TX.BLOCKED_ANSWER
    assert spark.range(1).select(RT.unknown_response()["confidence"]).first()[0] == 0.0
