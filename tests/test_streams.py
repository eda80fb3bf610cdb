"""Streams over several micro-batches, with a restart, equal the batch result."""

import time

from pyspark.sql import functions as F

from ordlens.functions import scoring as S
from ordlens.operators.features import FEATURE_ORDER
from ordlens.streaming import jobs as J

SCHEMA = ("order_id long, product_category string, price_inr double, discount_pct double, payment_method string, "
          "customer_tenure_days int, num_previous_orders int, num_previous_returns int, delivery_distance_km double, "
          "delivery_days int, is_weekend_order int, rating_given double")


def orders(spark, ids):
    rows = [(i, "Electronics" if i % 2 else "Fashion - Footwear", None if i % 7 == 0 else 100.0 * i, 5.0, "COD", i, 3, i % 3, 8.0, 4,
             i % 2, None) for i in ids]
    return spark.createDataFrame(rows, SCHEMA)


def done(q):
    q.awaitTermination()
    assert q.exception() is None


def test_scoring_with_rejects_and_restart(spark, tmp_path):
    src, sink, bad, ck = (str(tmp_path / n) for n in ("src", "sink", "bad", "ck"))
    df = orders(spark, range(40))
    for part in (range(0, 25), range(25, 40)):  # the second part arrives after the first query has ended
        orders(spark, part).repartition(4).write.mode("append").parquet(src)
        done(J.score_orders_stream(spark, src, df.schema, sink, bad, ck, files_per_batch=2))
    got = {r.order_id: (r.p, r.risk_bucket) for r in spark.read.parquet(sink).collect()}
    want = df.where("price_inr is not null").withColumn("p", S.sigmoid(S.scorecard_logit()))
    assert got == {r.order_id: (r.q, r.b) for r in want.select(
        "order_id", F.round("p", 6).alias("q"), S.risk_bucket(F.col("p")).alias("b")).collect()}
    rejects = spark.read.parquet(bad)
    assert {r.order_id for r in rejects.collect()} == {i for i in range(40) if i % 7 == 0}
    assert "price_inr" in FEATURE_ORDER and rejects.first().error.endswith(": price_inr")
    assert spark.read.parquet(sink).select("epoch").distinct().count() >= 3


def test_state_keeps_the_last_reference_over_batches(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    schema = "conv_id long, turn long, query string, order_ref string"
    first = [(c, t, "about ORD-%d please" % (100 * c + t) if t == c % 4 else "and?", None) for c in range(6) for t in range(4)]
    later = [(1, 9, "same one", None), (2, 9, "now ORD-999", None), (7, 0, "hello", None)]
    for rows in (first, later):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(src)
        done(J.conversation_state_stream(spark, src, spark.createDataFrame(first, schema).schema, sink, ck, files_per_batch=1))
    got = {r.conv_id: (r.last_order_ref, r.last_turn) for r in J.latest_state(spark, sink).collect()}
    want = {c: (f"ORD-{100 * c + c % 4}", 3) for c in range(6)} | {1: ("ORD-101", 9), 2: ("ORD-999", 9), 7: (None, 0)}
    assert got == want


def states(spark, src, rows, sink, ck, ttl):
    schema = "conv_id long, turn long, query string, order_ref string"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(src)
    done(J.conversation_state_stream(spark, src, df.schema, sink, ck, ttl_seconds=ttl))
    return {r.conv_id: (r.last_order_ref, r.last_turn) for r in J.latest_state(spark, sink).collect()}


def test_state_expires_and_starts_anew(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    assert states(spark, src, [(1, 0, "about ORD-1", None), (2, 0, "about ORD-2", None)], sink, ck, 3) == {1: ("ORD-1", 0), 2: ("ORD-2", 0)}
    time.sleep(4)
    # the next batch finds both expired; only 3 has arrived
    assert states(spark, src, [(3, 0, "hello", None)], sink, ck, 3) == {3: (None, 0)}
    # a late turn of an expired conversation knows no order
    assert states(spark, src, [(1, 5, "and that one?", None)], sink, ck, 60)[1] == (None, 5)
    folded = J.fold_epochs(spark, sink, str(tmp_path / "folded"))
    assert {r.conv_id for r in folded.collect()} >= {1} and 2 not in {r.conv_id for r in folded.collect()}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_replies_carry_references_over_batches_and_a_restart(spark, tmp_path):
    src, sink, state, ck = (str(tmp_path / n) for n in ("src", "sink", "state", "ck"))
    schema = "conv_id long, turn long, query string, order_ref string, image_id long"
    waves = [[(1, 0, "ORD-5 please", "ORD-5", None), (2, 0, "hello", None, None), (1, 1, "return risk?", None, None)],
             [(1, 2, "risk bucket again?", None, None), (2, 1, "risk?", None, None)],
             [(2, 2, "ORD-9 risk", "ORD-9", None), (1, 3, "risk?", None, None)], [(2, 3, "risk?", None, None)]]
    df = spark.createDataFrame(waves[0], schema)
    answer = lambda r: r.select("conv_id", "turn", "intent", "carried_order_ref")
    for pair in (waves[:2], waves[2:]):  # a restart between the pairs
        for w in pair:
            spark.createDataFrame(w, schema).coalesce(1).write.mode("append").parquet(src)
            time.sleep(1.1)  # files are read in order of their time
        done(J.route_stream(spark, src, df.schema, sink, state, ck, answer, files_per_batch=1))
    got = {(r.conv_id, r.turn): r.carried_order_ref for r in spark.read.parquet(sink).collect()}
    assert got == {(1, 0): "ORD-5", (1, 1): "ORD-5", (1, 2): "ORD-5", (1, 3): "ORD-5", (2, 0): None, (2, 1): None, (2, 2): "ORD-9", (2, 3): "ORD-9"}
    assert spark.read.parquet(sink).select("epoch").distinct().count() == 4
    assert {r.conv_id: r.last_order_ref for r in J.state_before(spark, state).collect()} == {1: "ORD-5", 2: "ORD-9"}
