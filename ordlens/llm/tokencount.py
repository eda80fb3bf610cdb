"""Token counts through a digest cache.

A text's key is the digest of its normalised content together with the digest
of the tokenizer's version (its file, the library and its release). Keys are
joined to the stored counts; only the distinct texts without one are encoded,
and their counts are appended to the cache. A text that was counted once, in
this corpus or by an earlier run, is never encoded again.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlens.llm.minhash import batches
from ordlens.llm.tokens import release_memory
from ordlens.session import materialize

CACHE_SCHEMA = "digest string, n_tokens long, version string"
#: Characters of text per batch, and about how many the library gets at a time.
BATCH_CHARS, SLICE_CHARS = 4 << 20, 1 << 19
#: Words whose counts a worker keeps; beyond that it starts anew.
WORDS = 300_000
#: Digests of more than this share of all rows (so at most that many) meet their counts by a broadcast.
HOT_SHARE = 1 / 256
_ENCODERS: dict[str, object] = {}


def library_of(path: str) -> str:
    """The library that reads the file: by its ending."""
    return "sentencepiece" if path.endswith(".model") else "tokenizers"


def tokenizer_version(path: str) -> str:
    """Digest of all that a count depends on besides the text: the file, the library and its release."""
    import importlib.metadata

    h = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    h.update(f"{library_of(path)} {importlib.metadata.version(library_of(path))}".encode())
    return h.hexdigest()


class Counter:
    """Token counts of texts by the file's own library, special strings handled as its default."""

    #: A run that ends before a blank ends a pre-token too: byte-level files never merge across it.
    _cut = re.compile(r"(?<=\S)(?=[ \n])")

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if library_of(path) == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.divisible = False
        else:
            import json

            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self._lengths = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                j = json.load(f)
            split = j["pre_tokenizer"] or {}
            # only the byte-level split is known to end a pre-token before every blank, and special strings
            # must not hold or take in blanks
            self.divisible = (j["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                              and not split.get("add_prefix_space") and not any(
                                  a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"])
                                  for a in j["added_tokens"]))

    def slices(self, text: str) -> list[str]:
        """A long text in slices of about ``SLICE_CHARS`` characters whose counts add up to its own."""
        if not self.divisible or len(text) <= SLICE_CHARS:
            return [text]
        out, at = [], 0
        while len(text) - at > SLICE_CHARS:
            m = self._cut.search(text, at + SLICE_CHARS)
            if not m:
                break
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _counted(self, group: list[str]) -> list[int]:
        """Count of each slice: the library sees each word (up to the next blank) once while the worker keeps it."""
        if not self.divisible:
            return self._lengths(group)
        words = [self._cut.split(s) for s in group]
        known = self.known
        missing = set().union(*words).difference(known)
        if len(known) + len(missing) > WORDS:
            known.clear()
            missing = set().union(*words)
        missing = list(missing)
        known.update(zip(missing, self._lengths(missing)))
        return [sum(map(known.__getitem__, w)) for w in words]

    def counts(self, texts: list[str]) -> list[int]:
        """Token count of each text; about ``SLICE_CHARS`` characters are in work at a time."""
        parts = [self.slices(t) for t in texts]
        lengths: list[int] = []
        group, chars = [], 0
        for s in (s for p in parts for s in p):
            group.append(s)
            chars += len(s)
            if chars >= SLICE_CHARS:
                lengths += self._counted(group)
                group, chars = [], 0
        lengths += self._counted(group) if group else []
        at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        return np.diff(at[np.concatenate(([0], ends))]).tolist()


def counter(path: str) -> Counter:
    """This worker's counter of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Counter(path)
    return _ENCODERS[path]


def _count(path: str):
    def run(it):
        c = counter(path)
        for rb in batches(it, "text", BATCH_CHARS):
            yield pa.RecordBatch.from_arrays(
                [rb.column("digest"), pa.array(c.counts(rb.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])
        release_memory()

    return run


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for a tokenizer version; a digest that a repeated append holds twice counts once."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").partitionBy("version").parquet(cache)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Counts are those of the file's library (tokenizers for .json,
    sentencepiece for .model) over whole texts, without added special tokens,
    truncation or padding. Normalised content is the text with null as the
    empty string (0 bytes); the file's own normaliser belongs to the version.
    ``cache`` is a folder that all executors share; it grows by the distinct
    texts that it lacked. Null keys and repeated rows come back as they are,
    other columns are ignored, an empty table gives an empty result. Memory
    is bounded by batches; only a text of one tokenizer that knows no safe
    cut, or without any blank, goes to the library in one piece.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    content = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("key"), content.alias("text"), F.sha2(content, 256).alias("digest"))
    keyed = materialize(texts.select("key", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "count-keys")
    known = stored_counts(spark, cache, version)
    missing = keyed.select("digest").distinct().join(known, "digest", "left_anti")
    if not missing.isEmpty():
        # copies combine before the shuffle; texts that the cache has do not move at all
        new = texts.select("digest", "text").join(known, "digest", "left_anti") if not known.isEmpty() else texts
        found = new.groupBy("digest").agg(F.first("text").alias("text")).mapInArrow(_count(path), "digest string, n_tokens long")
        found.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
        known = stored_counts(spark, cache, version)
    rows = keyed.count()
    hot = [r[0] for r in keyed.groupBy("digest").count().where(F.col("count") > max(rows * HOT_SHARE, 1)).collect()]
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    counted = keyed.where(~is_hot).join(known, "digest")
    if hot:
        counted = counted.unionByName(keyed.where(is_hot).join(F.broadcast(known.where(is_hot)), "digest"))
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
