"""Retrieval over real text: benchmark passages as labelled queries over document chunks.

A document is relevant to a passage if one of its sentence chunks has the
text of one of the passage's chunks (an equi-join on the chunk text), so a
passage can have any number of relevant documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import text as TO
from ..session import materialize
from ..sources.tables import Tables
from . import text as PT
from .registry import query

TOP_CHUNKS = 5

SQL_PASSAGES = PT.SQL_TFIDF + f""",
qtok AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM benchmark),
qtf AS (SELECT item_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % {PT.TFIDF_DIM} AS j, count(*) AS tf
        FROM qtok WHERE t <> '' GROUP BY ALL),
qw AS (SELECT item_id, j, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS n
       FROM qtf JOIN idf USING (j)),
score AS (SELECT qw.item_id, w.chunk_id, sum(qw.w * w.w) / any_value(qw.n * norm.n) AS s
          FROM qw JOIN w USING (j) JOIN norm ON norm.chunk_id = w.chunk_id
          WHERE qw.n > 0 AND norm.n > 0 GROUP BY qw.item_id, w.chunk_id),
hit AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, {R.TIE_DIGITS}) DESC, chunk_id) AS rank
        FROM score QUALIFY rank <= {TOP_CHUNKS})"""


def passage_hits(spark, sf_dir):
    """The chunks, the passages, and (query_id, rank, vec_id, score, doc_id, text): the best chunks of every benchmark passage."""
    index = PT.policy_index(spark, sf_dir)
    q = Tables(spark, sf_dir).benchmark.select("item_id", "text")
    return index.chunks, q, index.hits(q, "item_id", "text", TOP_CHUNKS)


@query("benchmark_answers", "WITH " + SQL_PASSAGES + """,
doc AS (SELECT h.*, k.doc_id, k.text FROM hit h JOIN kept k USING (chunk_id)
        QUALIFY row_number() OVER (PARTITION BY item_id, k.doc_id ORDER BY rank) = 1)
SELECT item_id, count(*) AS n_evidence, string_agg(text, ' ' ORDER BY rank) AS answer, round(max(s), 4) AS confidence
FROM doc WHERE s >= 0.4 GROUP BY item_id""")
def q_benchmark_answers(spark, sf_dir):
    """TOP3 without a limit: the best chunk of every document that reaches the floor, real text."""
    _, q, hits = passage_hits(spark, sf_dir)
    ans = R.grounded_answers(q.select(F.col("item_id").alias("query_id")), hits, 0.4, None)
    return ans.where("grounded").select(F.col("query_id").alias("item_id"), F.col("n_evidence").cast("long").alias("n_evidence"),
                                        "answer", "confidence")


@query("benchmark_retrieval", "WITH " + SQL_PASSAGES + """,
qpieces AS (SELECT item_id, trim(unnest(string_split(regexp_replace(trim(text, """ + PT.SQL_WS_CHARS + """),
              '([.!?])""" + PT.WS + """+', '\\1' || chr(1), 'g'), chr(1))), """ + PT.SQL_WS_CHARS + """) AS text FROM benchmark),
rel AS (SELECT DISTINCT item_id, k.doc_id FROM qpieces q JOIN kept k ON k.text = q.text WHERE length(q.text) > 0),
got AS (SELECT DISTINCT item_id, k.doc_id FROM hit JOIN kept k USING (chunk_id)),
n AS (SELECT b.item_id, (SELECT count(*) FROM got WHERE got.item_id = b.item_id) AS n_retrieved,
             (SELECT count(*) FROM rel WHERE rel.item_id = b.item_id) AS n_relevant,
             (SELECT count(*) FROM got JOIN rel USING (item_id, doc_id) WHERE got.item_id = b.item_id) AS n_hits
      FROM benchmark b)
SELECT item_id, n_retrieved, n_relevant, n_hits, round(coalesce(n_hits / nullif(n_retrieved, 0), 0), 6) AS precision,
       round(coalesce(n_hits / nullif(n_relevant, 0), 0), 6) AS recall FROM n""")
def q_benchmark_retrieval(spark, sf_dir):
    """TXT10 with labelled queries: precision over the distinct documents returned, recall over all relevant ones."""
    ch, q, hits = passage_hits(spark, sf_dir)
    pieces = TO.sentence_chunks(q, "item_id", "text").select("item_id", "text")
    rel = materialize(pieces.join(ch.select("doc_id", "text"), "text").select("item_id", "doc_id").distinct(), "relevant")
    got = hits.select(F.col("query_id").alias("item_id"), "doc_id").distinct()
    both = got.join(rel.withColumn("hit", F.lit(1)), ["item_id", "doc_id"], "left").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_retrieved"), F.count("hit").alias("n_hits"))
    n = q.select("item_id").join(both, "item_id", "left").join(
        rel.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_relevant")), "item_id", "left").fillna(0)
    share = lambda of: F.round(F.coalesce(F.col("n_hits") / F.nullif(F.col(of), F.lit(0)), F.lit(0.0)), 6)
    return n.select("item_id", "n_retrieved", "n_relevant", "n_hits", share("n_retrieved").alias("precision"),
                    share("n_relevant").alias("recall"))
