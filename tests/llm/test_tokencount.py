import pytest
from llm.helpers import edge_docs, edge_rows, no_docs
from ordlens.llm import tokencount
from ordlens.llm.plans import tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ODD = ["Hello  World's <|endoftext|> é a!!", "a<|endoftext|>b", "  \n\n x\t y \n", "日本語 テスト", "'S it'll", "🙂 éx", "\x1c \x85 z",
       "one\n\n\ntwo  three   ", " x y"]
FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(FILE))


def brute(library, text):
    n = len(library.encode(text or "", add_special_tokens=False).ids)
    return len((text or "").encode()), n, n > 512


def test_counts_equal_the_library_and_the_cache_is_used(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencount, "SLICE_CHARS", 50)
    rows = [(r[0], r[1]) for r in edge_rows()] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = edge_docs(spark).select("doc_id", "text", "label").union(
        spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, label string"))
    cache = str(tmp_path / "cache")
    got = sorted((str(r[0]), *r[1:]) for r in tokencount.token_counts(docs, tokenizer_path(FILE), cache).collect())
    assert got == sorted((str(i), *brute(library, t)) for i, t in rows)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})
    # a second run encodes what is new, and nothing else: a poisoned stored count comes back
    more = docs.union(spark.createDataFrame([(500, "quite new", "x")], docs.schema))
    spark.sql("select sha2('two words', 256) digest, 99L n_tokens").withColumn(
        "version", F.lit(tokencount.tokenizer_version(tokenizer_path(FILE)))).write.mode("append").partitionBy("version").parquet(cache)
    again = {r[0]: r.n_tokens for r in tokencount.token_counts(more, tokenizer_path(FILE), cache).collect()}
    assert again[7] == again[8] == 99 and again[500] == brute(library, "quite new")[1]
    assert spark.read.parquet(cache).count() == stored.count() + 2


def test_versions_are_apart_and_empty_tables_are_empty(spark, tmp_path):
    import sentencepiece

    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "Some words, some more."), (2, None)], "doc_id long, text string")
    a = {r[0]: r.n_tokens for r in tokencount.token_counts(docs, tokenizer_path(FILE), cache).collect()}
    b = {r[0]: r.n_tokens for r in tokencount.token_counts(docs, tokenizer_path("piece_bpe_32k.model"), cache).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert b == {1: len(model.encode("Some words, some more.")), 2: 0} and a[2] == 0
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
    assert tokencount.token_counts(no_docs(spark), tokenizer_path(FILE), cache).count() == 0


def test_slices_add_up(library, monkeypatch):
    monkeypatch.setattr(tokencount, "SLICE_CHARS", 7)
    monkeypatch.setattr(tokencount, "WORDS", 5)
    c = tokencount.Counter(tokenizer_path(FILE))
    for t in [*ODD, " ".join(ODD) * 3, "x" * 40, " " * 40 + "y", "a \n b" * 9]:
        assert "".join(c.slices(t)) == t and c.counts([t]) == [len(library.encode(t, add_special_tokens=False).ids)]
    assert tokencount.Counter(tokenizer_path("word_bpe_49k.json")).divisible is False
