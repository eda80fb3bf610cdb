import zlib
from collections import Counter

import numpy as np
from llm.helpers import edge_docs, labels, no_docs
from ordlens.llm import mil, toxicity
from ordlens.llm.plans import QUERIES
from ordlens.sources.tables import table

SF = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_on_held_out_labels(spark):
    rows = QUERIES["op10_attention_quality"](spark, SF).collect()
    truth = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert len(rows) == 1000 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    s = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [a for a, y in s if y], [a for a, y in s if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([a >= 0.3 for a in good]) > 0.97 and np.mean([a < 0.3 for a in bad]) > 0.7


def test_quality_edge_rows(spark):
    lab = labels(spark, [(1, 1, 0), (3, 0, 0), (9, None, 0), (None, 1, 1), (7, 0, 0), (7, 1, 0)])
    rows = mil.quality_scores(edge_docs(spark), lab).collect()
    assert len(rows) == 14 and all(np.isfinite(r.score) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[4] == by[5] == by[6] and by[1] == by[2]
    assert {r.score for r in mil.quality_scores(edge_docs(spark), labels(spark, [])).collect()} == {0.5}
    assert mil.quality_scores(no_docs(spark), lab).count() == 0


def test_passage_features_do_not_depend_on_the_batch():
    texts = ["Ab cd! " * 100, None, "x", "### $$ | | " * 40, " ", "é ü " * 70]
    x, per = mil.passage_features(texts)
    assert per.tolist() == [4, 1, 1, 3, 1, 3]
    alone = [mil.passage_features([t])[0] for t in texts]
    assert np.array_equal(x, np.concatenate(alone))


def test_attention_gradient():
    """The analytic gradient step lowers the loss, and attention weights sum to one."""
    rng = np.random.default_rng(0)
    per = rng.integers(1, 6, 300)
    x = rng.normal(size=(per.sum(), 5))
    hot = np.add.reduceat(x[:, 0] > 1.2, np.cumsum(per) - per) > 0
    m = mil.fit(x, per, hot.astype(float), epochs=60)
    p = m.score(x, per)
    assert np.mean((p > 0.5) == hot) > 0.9
    h, e = m.passages(x)
    assert np.allclose(np.add.reduceat(mil._attention(e, per), np.cumsum(per) - per), 1)


def test_toxicity_on_held_out_labels(spark):
    rows = QUERIES["op3_toxicity_chain"](spark, SF).collect()
    truth = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    assert len(rows) == 1000
    c = Counter((truth[r.doc_id], r.rejected) for r in rows if r.held_out and r.doc_id in truth)
    assert c[(0, True)] <= 2 and c[(1, True)] >= 0.5 * (c[(1, True)] + c[(1, False)])
    assert all(r.kept != r.rejected for r in rows)


def test_toxicity_edge_rows(spark):
    lab = labels(spark, [(1, 1, 1), (3, 0, 0), (9, 0, None), (None, 1, 1), (7, 0, 0), (7, 1, 1)])
    rows = toxicity.toxicity_scores(edge_docs(spark), lab.select("doc_id", "toxic")).collect()
    assert len(rows) == 14 and all(0 <= r.p_toxic <= 1 for r in rows)
    assert not any(r.rejected for r in toxicity.toxicity_scores(edge_docs(spark), labels(spark, [])).collect())
    assert toxicity.toxicity_scores(no_docs(spark), lab).count() == 0


def test_chain_feeds_earlier_categories():
    """A category that depends on the one before is found through its probability."""
    rng = np.random.default_rng(1)
    ids, sets, first = [], [], []
    for i in range(900):
        a = rng.random() < 0.06  # rarer than MAX_SHARE
        ids.append(i)
        first.append(float(a))
        sets.append(np.unique(np.append(rng.integers(100, 60_000, 40), [7] if a else [])).astype(np.int32))
    y = np.array(first)
    chain = toxicity.fit_chain(ids, sets, {"one": y, "two": y}, np.ones(len(y)))
    assert chain.links[1].chain[0] > 0
    p = chain.predict(sets)
    assert np.mean((p[:, 1] >= chain.cut) == (y > 0)) > 0.99


def test_frequent_toxic_terms_stay_in_a_full_sample():
    """A term in 30 % of toxic texts and in no clean one is kept with both classes at MAX_FIT_DOCS; common words go."""
    rng = np.random.default_rng(2)
    n = toxicity.MAX_FIT_DOCS
    y = np.repeat([1.0, 0.0], n)
    hot = (rng.random(2 * n) < 0.3) & (y > 0)
    often = rng.random(2 * n) < np.where(y > 0, 0.3, 0.2)
    sets = [np.unique([*rng.integers(100, 60_000, 20), *[7] * int(h), *[9] * int(o)]).astype(np.int32)
            for h, o in zip(hot, often)]
    chain = toxicity.fit_chain(list(range(2 * n)), sets, {"toxic": y}, np.where(y > 0, 1.0, 9.0))
    assert 7 in chain.links[0].slots and 9 not in chain.links[0].slots
    assert (chain.predict(sets)[hot, 0] >= chain.cut).all()


def test_toxicity_of_long_texts(spark):
    """Long labelled texts reach the fit; of texts of any length, clean ones are kept and toxic ones are not."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(6000)])
    rare = 1 / np.arange(1, len(words) + 1)

    def text(n, terms=0):
        w = rng.choice(words, n, p=rare / rare.sum()).astype(object)
        w[rng.integers(0, n, terms)] = rng.choice(["idiot", "loser", "scum"], terms)
        return " ".join(w)

    fit = [i for i in range(1, 500) if not held(i)]
    rows = [(i, text(4500, 60 * (i % 4 == 0))) for i in fit]
    assert min(len(t) for _, t in rows) > 20_000
    clean = {1000 + i: text(n) for i, n in enumerate([1, 30, 300, 20_000, 100_000, 100_000])}
    toxic = {2000 + i: text(n, n // 70 + 3) for i, n in enumerate([30, 300, 4500, 20_000, 100_000])}
    docs = spark.createDataFrame([*rows, *clean.items(), *toxic.items()], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in fit], "doc_id long, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.toxicity_scores(docs, lab).collect()}
    assert not any(got[i] for i in clean) and all(got[i] for i in toxic)


def test_long_joins_of_held_out_clean_texts(spark):
    """Clean texts joined to some 200,000 characters are kept, also with terms that are new to the chain."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    pool = {}
    for r in docs.collect():
        if held(r.doc_id) and truth.get(r.doc_id) == 0 and r.text:
            pool.setdefault(r.lang, []).append(r.text)
    rng = np.random.default_rng(0)
    long = []
    for k in range(12):
        texts = pool[["en", "de", "fr", "es"][k % 4]]
        joined = "\n".join(texts[i] for i in rng.permutation(len(texts)))[:200_000]
        long.append((10**9 + k, joined, None))
    both = docs.union(spark.createDataFrame(long, docs.schema))
    got = toxicity.toxicity_scores(both, table(spark, sf, "labels").select("doc_id", "toxic"))
    assert got.where(f"doc_id >= {10**9} and rejected").count() == 0


def test_long_labelled_texts_are_read_whole(spark, monkeypatch):
    """A term in any passage labels its text; over the bound every text gives an even share of its passages, one at least."""
    words = lambda n, tag: " ".join(f"{tag}{i % 97}" for i in range(n))
    far = words(5000, "w") + " idiot " + words(3000, "v")  # 32 passages, the term in the twentieth
    docs = spark.createDataFrame([(i, far) for i in range(1, 9)] + [(i, words(300, "w")) for i in range(9, 30)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 9)) for i in range(1, 30)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda ids, sets, targets, weight, per: seen.append((ids, targets, per)))
    for most in (48_000, 40):
        monkeypatch.setattr(toxicity, "MAX_FIT_PASSAGES", most)
        toxicity.train(docs.union(docs), lab)
    ids = [i for i in range(1, 30) if not held(i)]
    for (got, targets, per), share in zip(seen, (1, 40 / (32 * sum(i < 9 for i in ids)))):
        assert got == ids and targets["demeaning"].tolist() == targets["toxic"].tolist() == [float(i < 9) for i in ids]
        assert targets["contempt"].tolist() == [0.0] * len(ids)
        assert [p for i, p in zip(ids, per) if i < 9] == [int(32 * share)] * sum(i < 9 for i in ids)
        assert {p for i, p in zip(ids, per) if i >= 9} == {2}  # at most 40 passages, read whole
