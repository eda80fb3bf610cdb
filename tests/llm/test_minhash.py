import random
import re

from llm.helpers import edge_docs, no_docs
from ordlens.llm import minhash
from ordlens.llm.shingles import shingle_sets, word_spans


def brute(rows, k, num, den):
    """Smallest reachable id by exact sets of word tuples."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed, base_words, copies, edits):
    r = random.Random(seed)
    base = [f"b{r.randrange(10**6)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components_match_brute_force(spark):
    texts = family(1, 80, 60, 2) + family(2, 200, 60, 9) + family(3, 60, 40, 4) + ["a b", "A b", "x", "", None]
    rows = list(enumerate(texts, start=1))
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num, den in ((3, 85, 100), (5, 8, 10)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k, num, den).collect()}
        assert got == brute(rows, k, num, den)


def test_exact_pass_over_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    rows = list(enumerate(family(7, 90, 80, 5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85, 100).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_edge_rows(spark):
    got = minhash.near_duplicates(edge_docs(spark), 3, 85, 100).collect()
    assert len(got) == 14
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[2]] == [1, 1] and by[3][0].component_id == 1 and by[1][0].kept
    assert all(by[i][0].n_shingles == 0 and by[i][0].kept for i in (4, 5, 6))
    assert by[8][0].component_id == 7 and by[10][0].component_id == 9
    assert all(r.component_id is None and r.kept for r in by[None])
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_one_id_with_two_texts_joins_both(spark):
    a, b = family(11, 60, 1, 0)[0], family(12, 60, 1, 0)[0]
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85, 100).collect()}
    assert got == {1: 1, 5: 1, 9: 1}


def test_bands_miss_rarely():
    for num, den in ((85, 100), (8, 10), (1, 2)):
        b = minhash.plan_bands(num, den)
        assert (1 - (num / den) ** minhash.ROWS) ** b < minhash.MISS


def test_hashes_do_not_depend_on_place_or_piece(monkeypatch):
    from ordlens.llm import shingles
    text = "Alpha beta\tGAMMA x " * 50
    whole = shingle_sets([text], 3)[0]
    monkeypatch.setattr(shingles, "_PIECE", 16)
    both = shingle_sets(["other words here", text], 3)
    assert whole.tolist() == both[1].tolist()
    assert len(word_spans(["y" * 1000 + " z"])[3]) == 2
