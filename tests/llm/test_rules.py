import math
import re
from collections import Counter

from llm.helpers import edge_docs, edge_rows, labels, no_docs
from ordlens.llm import rules
from pyspark.sql import functions as F


def facts(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_facts(spark):
    texts = ["a b c a b c a b c", "a a a a", "x\n\ny\nx \nx\n \n", "é#|* & ü<>", "one two three four one two three", None, "",
             "p q r s p q r t q r s"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.base_facts(docs).collect()}
    assert got == {i: facts(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 10, 500, 2763, 200_000) for k in (0, 1, 3, 20, int(n * 0.008), int(n * 0.0099)) if k <= n]
    rows = spark.createDataFrame(cases, "n long, k long").withColumn("p", rules.binomial_tail(F.col("n"), F.col("k"), 0.01)).collect()
    for r in rows:
        if r.k >= r.n * 0.01:
            assert r.p == 1.0
            continue
        exact = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01)
                                   + (r.n - i) * math.log1p(-0.01)) for i in range(r.k + 1))
        assert math.isclose(r.p, exact, rel_tol=1e-6), (r, exact)


def test_cutoffs_limit_false_rejection(spark):
    """A clean stratum gets a cutoff, one whose good texts have as many symbols as the bad gets none, nor does a small one."""
    good = " ".join(f"w{i}" for i in range(60))
    junk = " ".join(f"w{i}##" for i in range(60))
    rows = [(i, good, "aa") for i in range(1500)] + [(10_000 + i, junk, "aa") for i in range(50)]
    rows += [(20_000 + i, junk if i % 3 else good, "bb") for i in range(1500)] + [(30_000, good, "cc"), (30_001, junk, "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = labels(spark, [(i, 0 if 10_000 <= i < 20_000 or i % 7 == 1 and i >= 20_000 else 1, 0) for i, _, _ in rows])
    got = {r.doc_id: r.kept for r in rules.quality_rules(docs, lab).collect()}
    assert all(got[i] for i in range(1500)) and not any(got[10_000 + i] for i in range(50))
    assert all(v for i, v in got.items() if i >= 20_000)


def test_edge_rows(spark):
    lab = labels(spark, [(1, 1, 0), (1, None, 0), (None, 1, 1), (2, 0, None)])
    got = rules.quality_rules(edge_docs(spark), lab).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_repeat_words) for r in got) == sorted(
        (str(r[0]), facts(r[1])[0], facts(r[1])[4]) for r in edge_rows())
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (4, 5, 6, 7))
    assert rules.quality_rules(no_docs(spark), lab).count() == 0
    assert rules.quality_rules(edge_docs(spark), labels(spark, [])).where("kept").count() == 5
