"""Registered training-data queries: one per operator, with SQL where SQL can say it."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlens.llm.bpe import bpe_digests
from ordlens.llm.html import main_text
from ordlens.llm.mil import quality_scores
from ordlens.llm.minhash import near_duplicates
from ordlens.llm.negatives import hard_negatives
from ordlens.llm.packing import pack
from ordlens.llm.repair import repair_digests
from ordlens.llm.rules import quality_rules
from ordlens.llm.sharding import extendible_shards
from ordlens.llm.tokencount import token_counts
from ordlens.llm.topk import exact_top_k
from ordlens.llm.toxicity import toxicity_scores
from ordlens.llm.urlfilter import url_verdicts
from ordlens.session import ensure_checkpoint_dir
from ordlens.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


#: Lower-cases A-Z only and splits on the six white-space bytes, in DuckDB.
SQL_WORDS = (
    r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    r" 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
)

OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(32) || w[i+1] || chr(32) || w[i+2])
    WHEN len(w) > 0 THEN [array_to_string(w, chr(32))] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
      FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op1_minhash_near_dedup", OP1_SQL)
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents``: 3-word shingles, similarity 85/100."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


OP2_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
             coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op2_exact_top_k", OP2_SQL)
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every row of ``embeddings`` whose id is divisible by 100."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1),
  lambda i: w[i] || chr(10) || w[i+1] || chr(10) || w[i+2])) AS g FROM d WHERE len(w) >= 3),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
f AS (SELECT doc_id, stratum, len(w) AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
  length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_capitals FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
s AS (SELECT *, unnest(['symbols', 'dup_lines', 'repeats', 'capitals']) AS rule,
  round(50 * unnest([coalesce(n_symbols / nullif(word_chars, 0)::DOUBLE, 0), coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0),
    coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0), coalesce(n_capitals / nullif(word_chars, 0)::DOUBLE, 0)]), 9) AS share
  FROM b),
y AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
x AS (SELECT stratum, rule, good, share FROM s JOIN y USING (doc_id) WHERE NOT base_failed),
k AS (SELECT stratum, rule, cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND share > cut) AS k,
  count(*) FILTER (NOT good AND share > cut) AS caught FROM x, (SELECT unnest(range(1, 51)) AS cut) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * 0.01 THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
  exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END AS tail FROM k),
z AS (SELECT *, max((tail > 0.05 / (SELECT count(*) FROM (SELECT DISTINCT stratum, rule FROM x)))::INTEGER)
  OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS stop FROM p),
a AS (SELECT stratum, rule, max_by(cut, (caught - 5 * k) * 100 + cut) AS cut, max(caught - 5 * k) AS gain
  FROM z WHERE stop = 0 GROUP BY ALL HAVING gain > 0),
v AS (SELECT s.doc_id, bool_or(share > a.cut) AS hit FROM s JOIN a USING (stratum, rule) GROUP BY s.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(hit, FALSE) AS kept
FROM b LEFT JOIN v USING (doc_id)
"""


@query("op6_quality_rules", OP6_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and risk-controlled verdicts over ``documents``; ``labels.quality`` is the holdout."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("broken")


OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
  lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
u AS (SELECT r, doc_id, n_bytes, d::INTEGER AS depth, substr(bits, 1, d::INTEGER) AS shard
      FROM d, (SELECT unnest(range(0, 41)) AS d)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, shard) AS b, count(*) OVER (PARTITION BY depth, shard) AS c FROM u)
SELECT doc_id, n_bytes, shard, depth, b::BIGINT AS shard_bytes, c AS shard_rows FROM s
WHERE b <= 1048576 OR c = 1 QUALIFY row_number() OVER (PARTITION BY r ORDER BY depth) = 1
"""


@query("op8_extendible_sharding", OP8_SQL)
def op8_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of ``documents`` of at most 1 MiB of text, hashed on doc_id."""
    return extendible_shards(table(spark, sf_dir, "documents"), limit_bytes=1 << 20)


URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)

OP9_SQL = """
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT max_by(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT max_by(v, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
    'allow') AS verdict
FROM u
"""


@query("op9_url_bloom_cascade", OP9_SQL)
def op9_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of every ``pages`` url; a url without a fitting rule is in no cascade and allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer file; without a name the word-level BPE one."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 4096 tokens; document slots and attention cost as a full sequence allows."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op7_bpe_encode_decode")
def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of all ``documents``."""
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_toxicity_chain")
def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and the verdict on every text of ``documents``; ``labels.toxic`` teaches it."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query("op10_attention_quality")
def op10_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text of ``documents``; ``labels.quality`` teaches it."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_html_wrapper_extraction")
def op5_html_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return main_text(table(spark, sf_dir, "pages"))


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``; the corpus (its path) has a count cache of its own in the checkpoint folder."""
    corpus = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    cache = os.path.join(ensure_checkpoint_dir(spark), f"token-counts-{corpus}")
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), cache)


OP12_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
p AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS n FROM s WHERE same QUALIFY n <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.a, n ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five positives of every anchor of ``embeddings``, and up to five hard negatives of each."""
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH RECURSIVE
t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
d0 AS (SELECT conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS code FROM k, t),
d AS (SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM d0 WHERE code <> 0),
n0 AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS ini, lag(left(role, 1)) OVER w AS prev,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut
  FROM d WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text))),
n AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again FROM n0),
m AS (SELECT conv, max(i) AS m, greatest(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY conv),
v(conv, i, f) AS (
  SELECT conv, m + 1, [0, 10, 5, 0]::BIGINT[] FROM m
  UNION ALL
  SELECT conv, i, CASE WHEN x THEN list_transform(f, lambda c: c + 2)
    ELSE [least(r[1], 5 + r[3], 10 + r[4]), least(r[2], 5 + r[3], 10 + r[4]), least(r[3], 5 + r[4]), least(r[4], 5 + r[3])] END
  FROM (SELECT v.conv, n.i, f, blank OR again AS x, [
      least(2 + f[1], 5 * cut::INT + CASE ini WHEN 'u' THEN f[3] WHEN 's' THEN least(f[2], 1 + f[3]) ELSE 1 + f[3] END),
      least(2 + f[2], 5 * cut::INT + (ini <> 'u')::INT + f[3]), least(2 + f[3], 5 * cut::INT + (ini <> 'a')::INT + f[4]),
      least(2 + f[4], 5 * cut::INT + (ini <> 'u')::INT + f[3])] AS r
    FROM v JOIN n ON n.conv = v.conv AND n.i = v.i - 1)),
e AS (SELECT v.conv, v.i, v.f, w.f AS g, n.role, n.text, n.ini, 5 * n.cut::INT AS c FROM v LEFT JOIN v w ON w.conv = v.conv AND w.i = v.i + 1
  LEFT JOIN n ON n.conv = v.conv AND n.i = v.i),
s(conv, i, s, audit, body) AS (
  SELECT conv, 1::BIGINT, 1, '', '' FROM m
  UNION ALL
  SELECT conv, CASE WHEN op = 'I' THEN i ELSE i + 1 END,
    CASE op WHEN 'D' THEN s WHEN 'K' THEN keep ELSE nxt END, audit || op,
    body || CASE op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
      WHEN 'R' THEN chr(10) || who || ':' || text ELSE chr(10) || who || ':' END
  FROM (SELECT *, CASE WHEN g IS NULL THEN 'I' WHEN f[s] = 2 + g[s] THEN 'D' WHEN f[s] = 5 + f[nxt] THEN 'I'
      WHEN f[s] = c + g[keep] THEN 'K' ELSE 'R' END AS op
    FROM (SELECT s.*, f, g, c, role, text, CASE WHEN s = 3 THEN 4 ELSE 3 END AS nxt, CASE WHEN s = 3 THEN 'assistant' ELSE 'user' END AS who,
        CASE WHEN ini = 's' AND s = 1 THEN 2 WHEN ini = 'u' AND s <> 3 THEN 3 WHEN ini = 'a' AND s = 3 THEN 4 END AS keep
      FROM s JOIN e ON e.conv = s.conv AND e.i = s.i WHERE g IS NOT NULL OR s IN (2, 3)))),
o AS (SELECT s.conv, audit, body FROM s JOIN m ON m.conv = s.conv AND i = m + 1 AND s IN (1, 4))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f[1], 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(substr(body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM k) LEFT JOIN m USING (conv) LEFT JOIN o USING (conv)
LEFT JOIN (SELECT conv, f FROM v WHERE i = 1) USING (conv)
"""


@query("op13_conversation_repair", OP13_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edit script and repaired digest of every conversation of ``conversations``."""
    return repair_digests(table(spark, sf_dir, "conversations"))
