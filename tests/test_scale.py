"""Work that must not grow faster than the rows: one scoring per row, one shuffle of wide rows, bounded tasks."""

import contextlib
import io
import random

import pyarrow.parquet as pq
from pyspark.ml import Estimator
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ordlens.operators import features as FT
from ordlens.operators import importance as IM
from ordlens.operators import metrics as M
from ordlens.operators import models as ML
from ordlens.operators import sampling as SM
from ordlens.operators import search as SE
from ordlens.operators import stats as ST
from ordlens.operators import text as TO
from ordlens.plans import models as MP
from ordlens.plans import risk as RK
from ordlens.plans import text as PT


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_auc_scores_every_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf(DoubleType())
    def score(i):
        seen.add(1)
        return None if i == 0 else float("nan") if i == 1 else (i % 7) / 7

    rows = spark.range(200).withColumn("label", (F.col("id") % 3 == 0).cast("int")).withColumn("p", score("id"))
    got = M.auc_counts(rows, n_buckets=5).first()
    assert seen.value == 200
    pairs = [((i % 7), int(i % 3 == 0)) for i in range(2, 200)]
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    assert tuple(got) == (len(pos), len(neg), sum(2 * (b < a) + (b == a) for a in pos for b in neg))


def test_prior_counts_broadcast_only_keys_of_several_ranges(spark):
    rng = random.Random(3)
    data = [(i, rng.choice([None, 1, 1, 1, 2, 3]), f"2020-01-{rng.randint(1, 9):02d}", rng.randint(0, 1)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, k int, day string, v int").withColumn("ts", F.to_timestamp("day"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = FT.prior_counts(df, "k", "ts", "id", "v", "n", "s", "first")
        assert "SortMergeJoin" not in _plan(out) and "BroadcastHashJoin" in _plan(out)
        got = {r["id"]: (r["n"], r["s"], str(r["first"])) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for i, k, day, _ in data:
        mine = [r for r in data if r[1] == k]
        earlier = [r for r in mine if (r[2], r[0]) < (day, i)]
        assert got[i] == (len(earlier), sum(r[3] for r in earlier), min(r[2] for r in mine))


def test_top_line_is_one_narrow_buffer(spark):
    lines = [(1, 5, 9, 1, 10.0), (1, 5, 7, 2, 10.0), (1, 6, 1, 3, 10.0), (1, 1, 1, 4, 9.0), (2, None, 3, 1, None), (2, 8, None, 2, None)]
    df = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double").withColumns(
        {"l_discount": F.lit(0.1), "l_returnflag": F.lit("R"), "l_shipdate": F.lit("2020-01-01").cast("timestamp")})
    out = FT.line_aggregates(df)
    assert {r["l_orderkey"]: tuple(r["top"]) for r in out.collect()} == {1: (5, 7), 2: (8, None)}
    assert "max_by" not in _plan(out)


def test_permuted_rows_are_dealt_by_copies(spark, monkeypatch):
    hold = spark.range(50).withColumns({"a": F.col("id") * 2, "b": F.col("id") % 3})
    usual = sorted(map(tuple, IM.permuted_rows(hold, "id", ["a", "b"], 4, 1).collect()))
    monkeypatch.setattr(IM, "COPIES", 40)
    many = IM.permuted_rows(hold, "id", ["a", "b"], 4, 1)
    assert "REPARTITION_BY_NUM" in _plan(many) and "hashpartitioning(id" in _plan(many)
    assert sorted(map(tuple, many.collect())) == usual and len(usual) == 50 * 2 * 4


def test_medians_share_one_histogram(spark, monkeypatch):
    sizes, array = [], F.array
    monkeypatch.setattr(ST.F, "array", lambda *a: sizes.append(len(a)) or array(*a))
    values = [(float(v), float(-v)) for v in (5, 1, 9, 4, 4, 7)] + [(None, float("nan"))]
    assert ST.exact_medians(spark.createDataFrame(values, "x double, y double"), ["x", "y"]) == {"x": 4.5, "y": -4.5}
    assert sizes[0] == 2  # a histogram per column, not per middle rank


def test_forest_rows_are_spread_and_big_grids_fit_one_by_one(spark, monkeypatch):
    rows = spark.range(100).coalesce(1)
    assert ML.spread(rows, "id").rdd.getNumPartitions() == 1
    assert ML.spread(rows, "id", 10).rdd.getNumPartitions() == 10 and ML.spread(rows, "id", 10).count() == 100
    at_once = []

    class Stop(Exception):
        pass

    def stop(**kw):
        at_once.append(kw["parallelism"])
        raise Stop

    monkeypatch.setattr(ML, "CrossValidator", stop)
    est = ML.PreparedEstimator(ML.forest("label"), ["id"], [])
    for most in (1000, 50):
        monkeypatch.setattr(ML, "SIDE_BY_SIDE_ROWS", most)
        with contextlib.suppress(Stop):
            ML.cross_validate(est, rows, {"numTrees": [1]}, "label")
    assert at_once == [4, 1]


def test_the_whole_grid_is_registered_and_large_forests_fit_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(MP, "rf_grid_search", lambda spark, sf_dir, grid=None: grid or MP.RF_GRID)
    assert MP.q_rf_grid(spark, "") == {"numTrees": [100, 200], "maxDepth": [6, 10, 30]}
    at_once = []

    class Stop(Exception):
        pass

    def stop(**kw):
        at_once.append(kw["parallelism"])
        raise Stop

    monkeypatch.setattr(ML, "CrossValidator", stop)
    est = ML.PreparedEstimator(ML.forest("label"), ["id"], [])
    for grid in (MP.SMALL_GRID, MP.RF_GRID):
        with contextlib.suppress(Stop):
            ML.cross_validate(est, spark.range(100_000), grid, "label")
    assert at_once == [4, 1]


def test_ranked_rows_are_shuffled_once(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, *range(150)]), rng.choice([None, 0, 1, 1, 1]), i) for i in range(300)]
    df = spark.createDataFrame(data, "k long, c int, wide long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = SM.ranked_within(df, ["c"], ["k"], 9, bucket_bits=3)
        shuffles = [x for x in _plan(out).split("\n") if "Exchange hashpartitioning" in x]
        got = out.withColumn("h", SM.seeded_hash(9, ["k"])).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(shuffles) == 4, shuffles  # bucket sizes, classes, offsets, and the rows once
    assert out.columns == ["k", "c", "wide", "class_size", "rank_in_class"]
    keyed = [r for r in got if r["k"] is not None]  # a null key has no hash, hence no bucket: its rows rank first
    for c in (None, 0, 1):
        mine = [r for r in got if r["c"] == c]
        assert len(mine) == sum(d[1] == c for d in data) and {r["class_size"] for r in mine} == {len(mine)}
        assert sorted(r["rank_in_class"] for r in mine) == list(range(1, len(mine) + 1))
        by_rank = [(r["h"], r["k"]) for r in sorted((r for r in keyed if r["c"] == c), key=lambda r: r["rank_in_class"])]
        assert by_rank == sorted(by_rank)


def test_forest_rows_are_shuffled_once_for_a_fit(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, i % 2, 1.0, float(rng.randint(0, 9)), rng.choice("ab"), rng.choice("xyz")) for i in range(120)]
    df = spark.createDataFrame(rows, "order_id long, label int, w double, v double, product_category string, payment_method string")
    df = df.select("*", *[F.col("v").alias(c) for c in FT.FEATURES_NUMERIC]).drop("v").coalesce(1)
    read, forest, kept = [], ML.forest("label", 2, 2), lambda: spark.sparkContext._jsc.getPersistentRDDs().size()

    class Watched(Estimator):
        def _fit(self, data):
            read.append(_plan(data))
            return forest.fit(data)

    stages = ML.fit_prep_stages
    monkeypatch.setattr(ML, "FIT_ROWS", 30)
    monkeypatch.setattr(ML, "fit_prep_stages", lambda train, *a: read.append(_plan(train)) or stages(train, *a))
    monkeypatch.setattr(RK, "estimator", lambda kind, train: Watched())
    before = kept()
    model = RK.fit("forest", df)
    assert "REPARTITION_BY_NUM" not in read[0]  # statistics, a pass each, read the rows where they lie
    assert "InMemoryTableScan" in read[1] and read[1].count("REPARTITION_BY_NUM") >= 1
    assert kept() == before
    assert model.transform(df).where("prediction is not null").count() == 120


def test_index_is_packed_in_place_and_searched_block_by_block(spark, tmp_path, monkeypatch):
    """Repeated ids are one document and null ids none; a worker gets one block of chunks and one of queries, and no chunk is shuffled."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, ". ".join(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(5))) for i in range(60)]
    df = spark.createDataFrame(docs + [(3, "w1 w2 w3. w4"), (None, "w5 w6"), (61, "... !")], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(SE, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(SE, "BLOCK_QUERIES", 4)
    PT.build_index(df, f"{tmp_path}/i")
    index = PT.PolicyIndex(spark, f"{tmp_path}/i")
    groups = [pq.ParquetFile(f).metadata for f in tmp_path.glob("i/counts/*.parquet")]
    assert sum(m.num_rows for m in groups) == sum(m.num_row_groups for m in groups) > 10
    assert not (tmp_path / "i/blocks").exists()  # weights follow from the counts
    ids = [i for r in index.counts.select("ids").collect() for i in r.ids]
    chunks = [r.chunk_id for r in index.chunks.collect() if r.chunk_id and r.text.strip(".! ")]
    assert len(ids) == len(set(ids)) and set(ids) == set(chunks) and len(chunks) > len(ids)

    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(12)], "q long, text string")
    tf = TO.term_counts(index.chunks, "chunk_id", "text", PT.TFIDF_DIM)
    vec = {}
    for r in TO.tfidf_vectors(tf.where("chunk_id is not null"), index.terms.withColumnRenamed("j", "_j"), "chunk_id").collect():
        vec[r.chunk_id] = dict(zip(r.idx, r.val))
    asked = {r.q: dict(zip(r.idx, r.val)) for r in TO.tfidf_vectors(
        TO.term_counts(q, "q", "text", PT.TFIDF_DIM), index.terms.withColumnRenamed("j", "_j"), "q").collect()}
    want = set()
    for i, terms in asked.items():
        scores = {c: sum(w * v[j] for j, w in terms.items() if j in v) for c, v in vec.items() if terms.keys() & v.keys()}
        best = sorted(scores, key=lambda c: (-round(scores[c], 9), c))[:3]
        want |= {(i, n, c, round(scores[c], 6)) for n, c in enumerate(best, 1)}
    rows_a_batch, plans, written = [], [], SE.materialize
    monkeypatch.setattr(SE, "materialize", lambda df, name, **options: (
        name == "best" and rows_a_batch.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), plans.append(_plan(df)),
        written(df, name, **options))[-1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.q, r["rank"], r.vec_id, round(r.score, 6)) for r in index.top_k(q, "q", "text", 3).collect()} == want
    assert len(rows_a_batch) >= 3 and set(rows_a_batch) == {"1"} and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert not any("CartesianProduct" in p or "NestedLoop" in p for p in plans)
    text_of = {}
    for r in index.chunks.collect():
        text_of.setdefault(r.chunk_id, set()).add(r.text)
    hits = index.hits(q, "q", "text", 3).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in hits} == want and all(r.text in text_of[r.vec_id] for r in hits)
    assert index.top_k(q.where("q < 0"), "q", "text", 3).collect() == []
