"""URL verdicts by a Bloom filter cascade.

Rules are (host, path prefix) keys. Every key that some URL of the corpus
could match is known (its host suffixes with its path prefixes): the key
universe. Level 1 of a cascade encodes the listed keys, level 2 the keys of
the universe that level 1 takes for listed, level 3 the listed keys that level
2 takes for those, and so on until no error is left. A probe walks the levels
until one says no, and is exact for every key of the universe, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlens.llm.shingles import mix
from ordlens.session import materialize

BITS_PER_KEY = 10
HASHES = 5
#: A level above this many bytes is not sent to the executors; membership is then a semi-join.
MAX_FILTER_BYTES = 64 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and path (up to ``? #``); else ''."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, "://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys that a rule fitting (host, path) can have, longest host and path first."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    heads = F.transform(F.filter(F.array(*map(F.lit, sorted(lengths, reverse=True))), lambda n: F.length(path) >= n),
                        lambda n: F.substring(path, 1, n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


@dataclass
class Level:
    """One Bloom filter: a bit array, probed at ``HASHES`` places."""

    words: np.ndarray
    seed: int

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in _places(h1, h2, len(self.words) * 64, self.seed).T:
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _places(h1: np.ndarray, h2: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The bits of each key at one level; the seed is mixed in, so that no two keys collide at every level."""
    base = mix(h1 ^ mix(np.array([seed], np.uint64)))
    step = mix(h2 + base) | np.uint64(1)
    return np.stack([((base + np.uint64(i) * step) >> np.uint64(7)) % np.uint64(size) for i in range(HASHES)], 1)


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


def _level(keys: DataFrame, n: int, seed: int) -> Level | None:
    """A filter over ``keys`` (h1, h2): bits are set by partition and united by Spark's bit_or."""
    words = -(-max(n * BITS_PER_KEY, 64) // 64)
    if words * 8 > MAX_FILTER_BYTES:
        return None

    def bits(it):
        for pdf in it:
            at = _places(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64), words * 64, seed).ravel()
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64),
                                "mask": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    rows = keys.select("h1", "h2").mapInPandas(bits, "word long, mask long").groupBy("word").agg(
        F.bit_or("mask").alias("mask"))
    got = rows.toPandas()  # at most ``words`` rows, checked above
    out = np.zeros(words, np.uint64)
    out[got.word.to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Level(out, seed)


class Cascade:
    """Exact membership of ``listed`` (key) over ``universe`` (key): levels, or None where they would be too large."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        inside = materialize(_hashed(listed.select("key").distinct()), "cascade-listed")
        outside = materialize(_hashed(universe.select("key").distinct().join(inside.select("key"), "key", "left_anti")),
                              "cascade-universe")
        self.levels: list[Level] | None = []
        side, n = [inside, outside], inside.count()
        while n:
            level = _level(side[0], n, len(self.levels) + 1)
            if level is None:
                self.levels = None
                return
            self.levels.append(level)
            wrong = materialize(side[1].where(pandas_walk([level])("h1", "h2")), "cascade-errors")
            side, n = [wrong, side[0]], wrong.count()


def _walk(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The number of levels that say yes in a row; an odd number means listed."""
    depth, open_ = np.zeros(len(h1), np.int64), np.ones(len(h1), bool)
    for level in levels:
        open_ &= level.holds(h1, h2)
        depth += open_
    return depth % 2 == 1


def pandas_walk(levels: list[Level]):
    @F.pandas_udf("boolean")
    def probe(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(_walk(levels, h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64)))

    return probe


def _classes(spark, allow: Cascade, block: Cascade):
    """array<long>, array<long> -> array<int>: 1 allow, 2 block, 0 neither, for each key's two hashes."""
    sent = spark.sparkContext.broadcast((allow.levels, block.levels))  # each level is at most MAX_FILTER_BYTES

    @F.pandas_udf("array<int>")
    def classes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = sent.value
        sizes = h1.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([np.zeros(0, np.int32)] * len(h1))
        x = np.concatenate(h1.to_list()).astype(np.int64).view(np.uint64)
        y = np.concatenate(h2.to_list()).astype(np.int64).view(np.uint64)
        code = np.where(_walk(b, x, y), 2, np.where(_walk(a, x, y), 1, 0)).astype(np.int32)
        return pd.Series(np.split(code, np.cumsum(sizes)[:-1]))

    return classes


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules``: (host, path, verdict 'allow' or 'block'); of the rules that fit,
    the one with the longest host, then the longest path, decides, and block
    goes before allow if one key has both. ``default`` is the verdict of a URL
    none of whose keys is in a cascade. A null URL, or one without ``://``,
    has empty host and path and fits no rule. Rows may repeat and have null
    ids, other columns are ignored, and an empty table or rule list is fine.
    """
    listed = materialize(rules.select(
        F.concat("host", "path").alias("key"), F.length("path").alias("n"), "verdict").distinct(), "url-rules")
    lengths = [r.n for r in listed.select("n").distinct().collect()]  # one int a length
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not lengths:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    longest = max(lengths)
    universe = materialize(
        urls.select("host", F.substring("path", 1, longest).alias("path")).distinct().select(
            F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct(), "url-universe")
    blocked, allowed = listed.where("verdict = 'block'").select("key"), listed.where("verdict = 'allow'").select("key")
    block, allow = Cascade(blocked, universe), Cascade(allowed, universe)
    keyed = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    if block.levels is None or allow.levels is None:
        return _by_join(urls, listed, lengths, default)
    h1 = F.transform("keys", lambda k: F.xxhash64(F.lit(1), k))
    h2 = F.transform("keys", lambda k: F.xxhash64(F.lit(2), k))
    coded = keyed.withColumn("code", _classes(pages.sparkSession, allow, block)(h1, h2))
    first = F.element_at(F.filter(F.arrays_zip("keys", "code"), lambda z: z["code"] > 0), 1)
    hit = F.when(F.exists("code", lambda c: c > 0), first)
    return coded.withColumn("hit", hit).select(
        "page_id", "host", "path", F.col("hit.keys").alias("rule"),
        F.when(F.col("hit.code") == 2, "block").when(F.col("hit.code") == 1, "allow").otherwise(default).alias("verdict"))


def _by_join(urls: DataFrame, listed: DataFrame, lengths: list[int], default: str) -> DataFrame:
    """The same verdicts by a join over distinct (host, path head), for lists too large for a filter in memory."""
    head = F.substring("path", 1, max(lengths))
    pairs = urls.select("host", head.alias("head")).distinct()
    hit = pairs.select("host", "head", F.posexplode(candidate_keys(F.col("host"), F.col("head"), lengths)).alias("at", "key")).join(
        listed.groupBy("key").agg(F.max("verdict").alias("verdict")), "key").groupBy("host", "head").agg(
        F.min_by(F.struct("key", "verdict"), "at").alias("hit"))
    return urls.withColumn("head", head).join(hit, ["host", "head"], "left").select(
        "page_id", "host", "path", F.col("hit.key").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
