"""Operator invariants against brute force on small generated inputs."""

import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ordlens.functions import text as TX
from ordlens.operators import features as FT
from ordlens.operators import importance as IM
from ordlens.operators import metrics as M
from ordlens.operators import prefix as PX
from ordlens.operators import retrieval as R
from ordlens.operators import search as SE
from ordlens.operators import routing as RT
from ordlens.operators import sampling as SM
from ordlens.operators import stats as ST
from ordlens.operators import text as TO


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    n = 3000
    p = np.round(rng.random(n), 2)          # many ties, values on the grid
    p[:50] = 0.47                           # exactly on a threshold
    y = (rng.random(n) < p).astype(int)
    cats = rng.choice(["a", "b", None], n)
    rows = [(i, int(y[i]), float(p[i]), cats[i]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label int, p double, cat string"), p, y


def test_sweep_equals_naive(scored):
    df, p, y = scored
    got = {r.threshold: r for r in M.threshold_sweep(df).collect()}
    assert len(got) == 81
    for i in range(10, 91):
        t = i / 100
        pred = p >= t
        tp = int((pred & (y == 1)).sum())
        fp = int((pred & (y == 0)).sum())
        r = got[round(t, 2)]
        assert (r.tp, r.fp) == (tp, fp)
        assert r.fn == int((y == 1).sum()) - tp


def test_auc_equals_rank_formula(scored):
    df, p, y = scored
    order = np.argsort(p, kind="mergesort")
    ranks = np.empty(len(p))
    sp = p[order]
    i = 0
    while i < len(sp):
        j = i
        while j + 1 < len(sp) and sp[j + 1] == sp[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    npos, nneg = y.sum(), (1 - y).sum()
    auc = (ranks[y == 1].sum() - npos * (npos + 1) / 2) / (npos * nneg)
    got = M.roc_auc(df, n_buckets=16).first().roc_auc   # few buckets: many scores per bucket
    assert got == pytest.approx(round(auc, 6))


def test_grouped_auc_with_null_group(scored):
    df, _, _ = scored
    got = M.roc_auc(df, group_cols=["cat"]).collect()
    assert len(got) == 3


def test_ranked_within_equals_plain_window(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    got = SM.ranked_within(df, ["c"], ["k"], 9, bucket_bits=3)
    w = Window.partitionBy("c").orderBy(SM.seeded_hash(9, ["k"]), "k")
    ref = df.withColumn("r", F.row_number().over(w))
    diff = got.join(ref, ["k", "c"]).where(F.col("rank_in_class") != F.col("r")).count()
    assert diff == 0


def test_stratified_split_and_folds(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    sp = SM.stratified_split(df, "y", "k", 0.2, 1)
    counts = {(r.split, r.y): r["count"] for r in sp.groupBy("split", "y").count().collect()}
    n1 = 144  # multiples of 7 in [0, 1002]
    assert counts[("test", 1)] == int(np.floor(n1 * 0.2 + 0.5))
    assert counts[("test", 0)] == int(np.floor((1003 - n1) * 0.2 + 0.5))
    folds = SM.stratified_folds(df, "y", "k", 5, 2).groupBy("y", "fold").count().collect()
    for yv in (0, 1):
        sizes = [r["count"] for r in folds if r.y == yv]
        assert max(sizes) - min(sizes) <= 1


def test_permutation_pairs_is_a_permutation(spark):
    df = spark.range(200).select(F.col("id").alias("k"))
    pairs = SM.permutation_pairs(df, "k", 3, 5).collect()
    for r in range(1, 4):
        recv = sorted(p.k for p in pairs if p.repeat == r)
        donors = sorted(p.donor_key for p in pairs if p.repeat == r)
        assert recv == donors == list(range(200))


def test_exact_medians_match_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=1001)
    b = rng.integers(0, 5, 1000).astype(float)
    rows = [(float(a[i]), float(b[i]) if i < 1000 else None) for i in range(1001)]
    df = spark.createDataFrame(rows, "a double, b double")
    med = ST.exact_medians(df, ["a", "b"])
    assert med["a"] == np.median(a)
    assert med["b"] == np.median(b)


def _py_chunks(doc_id, text):
    out = []
    for n, s in enumerate(re.split(r"(?<=[.!?])\s+", text.strip()), start=1):
        s = s.strip()
        if s:
            out.append((f"{doc_id}_CH{n}", doc_id, n, s))
    return out


def test_chunker_matches_python_split(spark):
    texts = ["", "   ", "No end mark", "One. Two!  Three?\nFour.", " lead. Nbsp split. ",
             "a.  . b", "x. 　y", "tab.\tthen", "Mark.\x1cfs sep", "end."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r) for r in TO.sentence_chunks(df).select("chunk_id", "doc_id", "pos", "text").collect())
    ref = sorted(c for i, t in enumerate(texts) for c in _py_chunks(i, t))
    assert got == ref


def test_carry_forward_and_history_across_buckets(spark):
    rows = []
    refs = {3: "A", 9: "B", 17: "C"}
    for t in range(25):
        rows.append((1, t, refs.get(t), "r%d" % t))
    rows += [(2, t, None, "s") for t in range(6)]
    df = spark.createDataFrame(rows, "conv long, turn long, ref string, role string")
    got = {(r.conv, r.turn): r.carried for r in RT.carry_forward(df, "conv", "turn", "ref", "carried", bucket=4)
           .collect()}
    last = None
    for t in range(25):
        last = refs.get(t, last)
        assert got[(1, t)] == last
    assert all(got[(2, t)] is None for t in range(6))
    # gaps in turn and conversations longer than any bucket: exact positions, no cap
    gaps = df.withColumn("turn", F.when(F.col("turn") > 10, F.col("turn") * 100).otherwise(F.col("turn")))
    for d in (df, gaps):
        rows = sorted((r.conv, r.turn, r.n_history, r.prev_turn) for r in RT.turn_positions(d, "conv", "turn", bucket=4).collect())
        for conv in (1, 2):
            own = [r for r in rows if r[0] == conv]
            assert [r[2] for r in own] == list(range(len(own)))
            assert [r[3] for r in own] == [None] + [r[1] for r in own[:-1]]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_block_topk_dense_matches_brute_force(spark, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(150, 8))
    v[10] = v[11]                       # duplicate vectors: exact ties, broken by id
    rows = [(i, [float(x) for x in v[i]]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    got = R.knn_topk(q, df, 4, exclude_self=True, block_rows=block).collect()
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    for qi in range(150):
        order = sorted(range(150), key=lambda j: (-round(s[qi, j], R.TIE_DIGITS), j))[:4]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == qi), key=lambda r: r.rank)]
        assert mine == order


def test_posting_topk_matches_dense(spark):
    """Salted postings, pruned terms, ties and queries with few partners against dense products."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9), p=np.array([30, 20] + [1] * 38) / 88)) for _ in range(150)]
    texts += ["w0", "w0 w1", "", "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tf = TO.term_counts(df, "id", "text", 1 << 12)
    terms, postings = SE.term_postings(tf, TO.fit_idf(tf, len(texts)), "id", postings=7)
    assert terms.agg(F.max("salts")).first()[0] > 3
    slot = {(r.id, r.j): r.w for r in postings.withColumnRenamed("chunk_id", "id").collect()}
    place = {j: i for i, j in enumerate(sorted({j for _, j in slot}))}
    m = np.zeros((len(texts), len(place)))
    for (i, j), w in slot.items():
        m[i, place[j]] = w
    s, shared = m @ m.T, (m > 0).astype(int) @ (m > 0).astype(int).T
    for k, seeds in ((3, 5), (3, 10_000), (500, 5)):
        got = SE.posting_topk(SE.query_weights(tf.withColumnRenamed("id", "q"), terms, "q"), postings, k, "q", seed_postings=seeds)
        got = got.collect()
        for q in range(len(texts)):
            want = sorted((j for j in range(len(texts)) if shared[q, j]), key=lambda j: (-round(s[q, j], R.TIE_DIGITS), j))[:k]
            mine = sorted((r for r in got if r.q == q), key=lambda r: r.rank)
            assert [r.vec_id for r in mine] == want
            assert all(abs(r.score - s[q, r.vec_id]) < 1e-12 for r in mine)


def test_tfidf_vectors_are_unit_norm(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, "...")], "id long, text string")
    tf = TO.term_counts(df, "id", "text", 64)
    vec = {r.id: r for r in TO.tfidf_vectors(tf, TO.fit_idf(tf, 3), "id", df).collect()}
    assert vec[3].idx == [] and vec[3].val == []
    assert sum(x * x for x in vec[1].val) == pytest.approx(1.0)


def test_py_strip_matches_python(spark):
    s = "　\x1c a b  \t"
    got = spark.range(1).select(TX.py_strip(F.lit(s)).alias("x")).first().x
    assert got == s.strip()


def test_running_values_of_a_hot_key_span_ranges(spark):
    """One conversation with most rows, all of one turn or none; a customer's orders all on one day: no block holds them."""
    rows = [(1, None if i % 3 == 0 else 7, f"r{i}" if i % 50 == 0 else None, i) for i in range(400)]
    rows += [(2, t, None, t) for t in range(5)] + [(None, 1, "x", 0), (None, 2, None, 1)]
    df = spark.createDataFrame(rows, "conv long, turn long, ref string, i long")
    blocks = PX.ordered_blocks(df, "conv", "turn", rows=40).groupBy(PX.BLOCK).count().collect()
    assert len(blocks) > 6 and max(r["count"] for r in blocks) < 200
    got = RT.turn_positions(df, "conv", "turn", bucket=40).collect()
    assert len(got) == len(rows)
    for conv in (1, 2, None):
        own = sorted((r for r in got if r.conv == conv), key=lambda r: r.n_history)
        assert [r.n_history for r in own] == list(range(len(own)))
        turns = [r.turn for r in own]
        assert turns == sorted(turns, key=lambda t: (t is not None, t))
        assert [r.prev_turn for r in own][1:] == turns[:-1]
    order = {(r.conv, r.i): r.n_history for r in got}
    carried = {(r.conv, r.i): r.carried for r in RT.carry_forward(df, "conv", "turn", "ref", "carried", bucket=40).collect()}
    assert carried[(None, 1)] == "x"
    last = None
    for i in sorted(range(400), key=lambda i: order[(1, i)]):
        last = f"r{i}" if i % 50 == 0 else last
        assert carried[(1, i)] == last
    day = spark.createDataFrame([(9, i, i % 2) for i in range(300)] + [(8, 1000, 1)], "c long, k long, y int").withColumn(
        "d", F.lit("2020-01-05").cast("date"))
    out = {r.k: r for r in FT.prior_counts(day, "c", "d", "k", "y", "n", "s", "first").collect()}
    assert [(out[i].n, out[i].s) for i in range(300)] == [(i, i // 2) for i in range(300)]
    assert (out[1000].n, out[1000].s, str(out[1000].first)) == (0, 0, "2020-01-05")
    assert FT.prior_counts(day.where("false"), "c", "d", "k", "y", "n", "s", "first").count() == 0


def test_permuted_rows_change_one_feature(spark):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 10).alias("a"), F.when(
        F.col("id") % 5 > 0, F.col("id").cast("string")).alias("b"), (F.col("id") % 2).alias("label"))
    donor = {(r.repeat, r.k): r.donor_key for r in SM.permutation_pairs(df, "k", 3, 4).collect()}
    got = IM.permuted_rows(df, "k", ["a", "b"], 3, 4).collect()
    name = lambda i: str(i) if i % 5 else None
    assert len(got) == 60 * 3 * 2
    for r in got:
        d = donor[(r.repeat, r.k)]
        assert (r.a, r.b) == ((d * 10, name(r.k)) if r.feature == "a" else (r.k * 10, name(d)))
        assert r.label == r.k % 2


def test_count_blocks_hold_all_counts_and_blocks_of_any_size_find_the_same(spark, monkeypatch):
    """Repeated ids are one vector, null ids none; several blocks of chunks and queries give the hits of one of each."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"c{i % 70}", " ".join(rng.choice(words, rng.integers(0, 12)))) for i in range(90)] + [(None, "w1 w1 w2"), ("z", "...")]
    df = spark.createDataFrame(rows, "id string, text string")
    slots = TO.term_slots(df, "id", "text", 64)
    tf = TO.term_counts(df, "id", "text", 64)
    want = {(r.id, r._j): r._tf for r in tf.where("id IS NOT NULL").collect()}
    monkeypatch.setattr(SE, "BLOCK_CHARS", 500)
    blocks = SE.materialize(SE.count_blocks(slots, "id", len(rows), 4000), "counts")
    assert blocks.count() > 3
    got = {}
    for b in blocks.collect():
        for n, j in enumerate(b.j):
            for at in range(b.first[n], b.first[n + 1]):
                assert (b.ids[b.row[at]], j) not in got
                got[b.ids[b.row[at]], j] = b.tf[at]
    assert got == want
    df_of = {r.j: r.df for r in SE.block_frequencies(blocks).collect()}
    assert df_of == {j: sum(1 for _, k in want if k == j) for j in {k for _, k in want}}
    idf = TO.fit_idf(tf.where("id IS NOT NULL"), 71)
    vec = {r.id: (r.idx, r.val) for r in TO.tfidf_vectors(tf.where("id IS NOT NULL"), idf, "id").collect()}
    mine = {r.id: (r.idx, r.val) for r in SE.count_vectors(blocks, idf, 64, "id").collect()}
    assert mine.keys() == vec.keys()
    assert all(mine[i][0] == vec[i][0] and np.allclose(mine[i][1], vec[i][1], atol=1e-12, rtol=0) for i in vec)
    terms = idf.withColumnRenamed("_j", "j")
    q = SE.query_weights(tf.where("id IS NOT NULL").withColumnRenamed("id", "q"), terms, "q")
    weights = SE.count_weights(blocks, idf, 64)
    hits = lambda: sorted((r.q, r["rank"], r.vec_id, round(r.score, 9)) for r in SE.block_topk(q, weights, 4, "q").collect())
    one = hits()
    monkeypatch.setattr(SE, "BLOCK_QUERIES", 9)
    assert hits() == one and len({x[0] for x in one}) == len(vec)
