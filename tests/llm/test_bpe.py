import hashlib

import pyarrow as pa
import pytest
from llm.helpers import edge_docs, edge_rows, no_docs
from ordlens.llm import bpe
from ordlens.llm.plans import tokenizer_path
from ordlens.llm.tokens import WordEncoder
from tokenizers import Tokenizer

ODD = ["Hello  World's <|endoftext|> é É it's 12 a!!", "x<|startoftext|>y", "<|ENDOFTEXT|>", "İstanbul ß ſ 'S 'ſ ΣΑΣ ΌΣ.",
       "é x y\x85z\x1cq​k", "", " ", None, "'S IT'S 're'llx", "日本語 テスト １２ ²½ªº × ÷ ŉ ǅ", "a\x00b ᠎ ﻿x 𝒳 😀👍🏽",
       "Å ́x İ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def test_encoder_matches_library_with_any_cache(library):
    for cache in (None, 3, 1000):
        ids, at = WordEncoder(tokenizer_path(), cache).encode(pa.array(ODD * 2))
        for i, t in enumerate(ODD * 2):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_digests_and_edge_rows(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 500)
    rows = [(r[0], r[1]) for r in edge_rows()] + [(100 + i, t) for i, t in enumerate(ODD)]
    docs = edge_docs(spark).select("doc_id", "text", "label").union(
        spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, label string"))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs, tokenizer_path()).collect())
    assert got == sorted((str(i), *expected(library, t)) for i, t in rows)
    assert bpe.bpe_digests(no_docs(spark), tokenizer_path()).count() == 0


def test_ids_and_text_round_trip(spark, library):
    docs = spark.createDataFrame([(1, "Some words, some more."), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.bpe_encode(docs, tokenizer_path()).collect()}
    assert got[1].ids == library.encode("Some words, some more.", add_special_tokens=False).ids
    assert got[1].decoded == library.decode(got[1].ids, skip_special_tokens=False) and got[2].ids == [] and got[2].decoded == ""
