import math
import random

from pyspark.sql import functions as F
from ordlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, query string, d double"


def brute(rows, k, step):
    vecs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in vecs:
        if q % step == 0:
            s = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in vecs if i != q and len(v) == len(qv))[:k]
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CORPUS_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "STEP", 9)
    monkeypatch.setattr(topk, "PIVOTS", 12)
    monkeypatch.setattr(topk, "GROUP", 5)
    r = random.Random(3)
    f = lambda: [r.choice((-0.5, 0.25, r.gauss(0, 1))) for _ in range(6)]
    f32 = lambda v: [None if x is None else spark_float(x) for x in v]
    rows = [(i, f32(f())) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (310, [float("nan")] * 6), (320, [float("inf")] * 6),
             (None, [1.0] * 6), (20, rows[20][1]), (20, rows[21][1]), (5, rows[5][1]), (5, rows[6][1]), (330, rows[0][1]), (340, [1.0, 2.0]), (341, [0.5, 2.0]), (350, [])]
    df = spark.createDataFrame([(*x, None, "q", None) for x in rows], SCHEMA)
    got = sorted(tuple(x) for x in topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
    assert got == brute(rows, 5, 10)
    scored = topk.search(df, F.col("vec_id") % 10 == 0, 5).where("qrow is not null")
    assert scored.agg(F.max("scored")).first()[0] <= 50


def test_repeated_rows_count_each(spark):
    rows = [(100, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0]), (3, [3.0]), (3, [0.5])]
    df = spark.createDataFrame([(*x, None, "q", None) for x in rows], SCHEMA)
    got = sorted(tuple(x) for x in topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute(rows, 10, 100) and len(got) == 5


def test_far_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(topk, "CORPUS_BLOCK", 100)
    r = random.Random(8)
    rows = [(i, f32ed([(i % 5) * 40 + r.random(), 3 + r.random() if i % 5 else -90.0, r.random()])) for i in range(1000)]
    df = spark.createDataFrame([(*x, None, "q", None) for x in rows], SCHEMA)
    hits = topk.search(df, F.col("vec_id") % 50 == 0, 5)
    total = hits.groupBy("qrow", "scored", "vec_id").count().groupBy("qrow").agg(F.sum("scored").alias("n"))
    assert sorted(tuple(x) for x in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, 5).collect()) == brute(rows, 5, 50)
    assert total.agg(F.avg("n")).first()[0] < 5 * 1000


def f32ed(v):
    return [spark_float(x) for x in v]


def spark_float(x):
    import struct
    return struct.unpack("f", struct.pack("f", x))[0]


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "a", 0.0), (1, [2.0], 1, "a", 0.0)], SCHEMA)
    assert [tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
