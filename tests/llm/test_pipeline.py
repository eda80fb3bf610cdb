import shutil
from collections import defaultdict

import corpus_pipeline as P
import pytest
from llm.helpers import edge_docs
from llm.test_minhash import brute
from ordlens.llm.mil import quality_scores
from ordlens.llm.plans import ORACLE, QUERIES, tokenizer_path
from ordlens.llm.toxicity import toxicity_scores
from ordlens.sources.tables import table
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_run_matches_direct_stages(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    lab = table(spark, SF, "labels")
    clean = {r.doc_id for r in toxicity_scores(table(spark, SF, "documents"), lab.select("doc_id", "toxic")).collect() if r.kept}
    left = spark.createDataFrame([tuple(docs[i]) for i in sorted(clean)], table(spark, SF, "documents").schema)
    good = {r.doc_id for r in quality_scores(left, lab).collect() if r.predicted == 1}
    root = brute([(i, docs[i].text) for i in good], 5, 8, 10)
    want = {i for i in good if root[i][1] == i}
    rows = P.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == want
    lib = Tokenizer.from_file(tokenizer_path())
    size = defaultdict(int)
    for r in rows:
        size[r.doc_id] += r.length
    assert size == {i: len(lib.encode(docs[i].text or "", add_special_tokens=False).ids) + 1 for i in want}


def test_stages_keep_columns_and_edge_rows(spark):
    docs = edge_docs(spark)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    kept = sorted(str(r.doc_id) for r in P.near_dedup(spark, docs, SF).collect())
    assert kept == sorted(map(str, [1, 4, 5, 6, 7, 9, 11, None, None]))
    assert P.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_unrelated_texts_of_one_id_all_stay(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in ("red", "blue"))
    rows = [(7, one, "a"), (7, two, "b"), (7, two, "c"), (8, one + " more", "d"), (9, "else " * 9, "e"), (None, one, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((str(r.doc_id), r.text) for r in P.near_dedup(spark, docs, SF).collect())
    texts = [t for _, t in got]
    assert texts.count(two) == 1 and len(got) == 4 and ("None", one) in got and ("9", "else " * 9) in got
    assert sum(i in ("7", "8") and t.startswith(one) for i, t in got) == 1


def test_names_of_stages():
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality classifier", "minhash near-dedup", "best-fit packing"]
    assert sorted(int(k[2 : k.index("_")]) for k in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.execute(ORACLE[name])
    cols = sorted(d[0] for d in want.description)
    rows = [dict(zip([d[0] for d in want.description], r)) for r in want.fetchall()]
    assert sorted(got.columns) == cols
    key = lambda r: tuple(str(r[c]) for c in cols)
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(map(key, rows))


def test_entry_imports_without_the_llm_part(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(P.__file__))
    to = tmp_path / "repo"
    shutil.copytree(root, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; assert not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env=os.environ | {"PYTHONPATH": str(to)})

