import math
import random
import struct

import numpy as np
from ordlens.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, score double"


def f32(v):
    return [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]


def brute(rows, k=5, m=5):
    vecs = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and label is not None
            and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, av, al) in enumerate(vecs):
        if a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, label) for j, (i, v, label) in enumerate(vecs) if i != a and len(v) == len(av)]
        for ps, p, _ in sorted(x for x in scored if x[2] == al)[:k]:
            found = sorted(x for x in scored if x[2] != al and 80 * -ps <= 100 * -x[0] <= 100 * -ps)[:m]
            out += [(a, p, r, i, -ps, -s) for r, (s, i, _) in enumerate(found, 1)]
    return sorted(out)


def test_matches_brute_force(spark, monkeypatch):
    for name, size in (("ROW_BLOCK", 40), ("ANCHOR_BLOCK", 9), ("STRIP", 3), ("DEPTH", 4)):
        monkeypatch.setattr(negatives, name, size)
    r = random.Random(5)
    make = lambda: f32([r.choice((0.5, 0.25, abs(r.gauss(0, 1)))) for _ in range(6)])
    rows = [(i, make(), r.choice((0, 1, 1, 2))) for i in range(200)]
    rows += [(201, None, 1), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (210, [float("nan")] * 6, 1), (220, [float("inf")] * 6, 1),
             (None, [1.0] * 6, 1), (230, [1.0] * 6, None), (20, rows[20][1], rows[20][2]), (30, make(), 2), (5, rows[5][1], 1),
             (240, [1.0, 2.0], 1), (241, [0.5, 2.0], 1), (242, [0.5, 1.9], 2), (250, [], 1), (251, [], 1), (252, [], 2)]
    df = spark.createDataFrame([(*x, "q", None) for x in rows], SCHEMA)
    got = sorted(tuple(x) for x in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rows) and len(got) > 200
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(df.where("vec_id % 10 > 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_up_to_the_limit(spark):
    big = 2.0**22  # components of 2^30: scores need all primes
    rows = [(0, f32([big, big]), 0), (1, f32([big, big * 0.9]), 0), (2, f32([big * 0.9, big * 0.9]), 1), (3, [3e38, 1.0], 1)]
    df = spark.createDataFrame([(*x, "q", None) for x in rows], SCHEMA)
    got = sorted(tuple(x) for x in negatives.hard_negatives(df, F.col("vec_id") == 0).collect())
    assert got == brute(rows[:3]) and got[0][4] > 2**60


def test_residue_product_is_exact():
    r = np.random.default_rng(1)
    for d, size in ((1, 2**30), (64, 300), (300, 2**20), (700, 5)):
        a, b = r.integers(-size, size, (5, d)), r.integers(-size, size, (4, d))
        primes = negatives.primes_for(min(d, negatives.DEPTH), d * size * size)
        every = slice(None)
        got = negatives.residue_product(negatives.Residues(a, primes), every, negatives.Residues(b, primes), every)
        assert (got == a @ b.T).all()
