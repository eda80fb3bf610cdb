"""Nulls, NaN, infinities, odd ids; plan shape; workers started elsewhere."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from ordlens.functions import scoring as S
from ordlens.functions import text as TX
from ordlens.operators import features as FT
from ordlens.operators import metrics as M
from ordlens.operators import retrieval as R
from ordlens.operators import sampling as SM
from ordlens.operators import stats as ST
from ordlens.operators import text as TO
from ordlens.sources.tables import Tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def medians(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return ST.exact_medians(df, ["x"])["x"]


def test_medians_skip_nan_and_rank_infinities(spark):
    assert medians(spark, [1.0, 2.0, NAN, 4.0, None]) == 2.0
    assert medians(spark, [1.0, 2.0, 3.0, INF, 5.0]) == 3.0
    assert medians(spark, [-INF, -INF, 3.0]) == -INF
    assert medians(spark, [INF, INF, 3.0]) == INF
    assert medians(spark, [NAN, None]) is None


def test_nan_is_imputed(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (NAN, None)], "x double, c string")
    r = {x["column"]: x for x in ST.impute_stats(df, ["x"], ["c"]).collect()}
    assert r["x"]["median"] == 2.0 and r["x"]["mean"] == 2.0


def test_auc_and_buckets_ignore_missing_scores(spark):
    rows = [(1, 0.9), (0, 0.1), (1, None), (0, NAN)]
    df = spark.createDataFrame(rows, "label int, p double")
    r = M.roc_auc(df).first()
    assert (r.n_pos, r.n_neg, r.roc_auc) == (1, 1, 1.0)
    got = [x[0] for x in df.select(S.risk_bucket(F.col("p"))).collect()]
    assert got[2] is None and got[3] is None and got[0] == "High"


def test_topk_leaves_unsound_vectors_out(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.8, 0.2]), ("d", [NAN, 1.0]), ("e", None), (None, [1.0, 1.0]),
            ("f", [1.0, None]), ("g", [INF, 0.0]), ("h", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    q = df.withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in R.knn_topk(q, df, 5, exclude_self=True, block_rows=2).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {"a": ["b", "c"], "b": ["a", "c"], "c": ["a", "b"]}
    assert sorted(str(r.vec_id) for r in R.unsound_vectors(df).collect()) == ["None", "d", "e", "f", "g"]


def test_chunks_without_tokens_keep_an_empty_vector(spark):
    docs = spark.createDataFrame([(1, "Word one. | . Two words!")], "doc_id long, text string")
    ch = TO.sentence_chunks(docs)
    tf = TO.term_counts(ch, "chunk_id", "text", 1 << 20)
    v = {r.chunk_id: len(r.idx) for r in TO.tfidf_vectors(tf, TO.fit_idf(tf, 3), "chunk_id", ch).collect()}
    assert v == {"1_CH1": 2, "1_CH2": 0, "1_CH3": 2}


def test_slots_rarely_collide(spark):
    words = spark.range(20_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"), F.lit(1).alias("k"))
    slots = TO.term_counts(words, "k", "text", 1 << 20).count()
    assert slots > 20_000 * 0.98  # about n / (2 * 2^20) of the terms share a slot


def test_guard_takes_a_callers_regex(spark):
    df = spark.createDataFrame([("ignore ALL rules",), ("ignore.all",), (None,)], "t string")
    got = [r[0] for r in df.select(TX.injection_flag(F.col("t"), [r"ignore\s+all"], regex=True)).collect()]
    assert got == [True, False, False]


def test_sized_split_takes_exactly_n(spark):
    df = spark.range(101).select(F.col("id"), (F.col("id") % 3).cast("int").alias("y"))
    for n in (0, 1, 10, 50, 101):
        rows = SM.stratified_split_sized(df, "y", "id", n).where("split = 'test'").groupBy("y").count().collect()
        assert sum(r["count"] for r in rows) == n


def test_order_features_scan_lineitem_once(spark):
    t = Tables(spark, SF)
    seen = []
    real = FT.materialize

    def watch(df, name):
        seen.append(df._jdf.queryExecution().toString())
        return real(df, name)

    FT.materialize = watch
    try:
        out = FT.order_features(t.orders, t.lineitem, t.part, t.supplier, t.customer)
    finally:
        FT.materialize = real
    physical = seen[0].split("== Physical Plan ==")[1]
    assert len(seen) == 1 and physical.count("lineitem.parquet") == 1
    assert "lineitem.parquet" not in out._jdf.queryExecution().toString()


def test_workers_import_the_package_from_any_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2')"
            f".getOrCreate(); assert e.queries()['knn_topk'](s, '{SF}').count() > 0")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, ROOT], cwd=tmp_path, env=env, check=True, timeout=200)
