"""The corpus pipeline: documents through four of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and reread as the next stage's documents. The first three return the
columns of their input and drop what they reject; the last returns the packed
pieces. Rows with a null doc_id can be neither labelled nor linked: the
classifiers judge them on their text like all others, the near-duplicate stage
keeps them. Extra columns pass through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlens.llm.mil import THRESHOLD, with_quality
from ordlens.llm.minhash import near_duplicates
from ordlens.llm.packing import pack
from ordlens.llm.plans import tokenizer_path
from ordlens.llm.toxicity import CHAIN, with_toxicity
from ordlens.session import materialize, ship_package
from ordlens.sources.tables import table

SHINGLE, SIMILARITY = 5, (8, 10)


#: Names of the columns that live inside a stage only.
TOXIC = [f"_stage_p_{name}" for name, _ in CHAIN]
SCORE = "_stage_quality"
ROW, DIGEST, NODE = "_stage_id", "_stage_digest", "_stage_node"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject."""
    ship_package(spark)
    scored, cut = with_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), TOXIC)
    return scored.where(F.col(TOXIC[-1]) < F.lit(cut)).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier predicts to be good."""
    ship_package(spark)
    scored = with_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), SCORE)
    return scored.where(F.col(SCORE) >= THRESHOLD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group.

    Rows of one doc_id with different texts are documents of their own: all
    but one of them get a number of their own for the grouping, so that an
    unrelated text is never dropped with another. Of equal rows of one doc_id
    and text one stays.
    """
    ship_package(spark)
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"),
                        "repeated-ids")
    if again.isEmpty():
        found = near_duplicates(docs, SHINGLE, *SIMILARITY)
        return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    digest = F.md5(F.coalesce("text", F.lit(""))).alias(DIGEST)
    several = docs.join(again, "doc_id", "left_semi").select(F.col("doc_id").alias(ROW), digest).distinct()
    top = docs.agg(F.max("doc_id")).first()[0]
    several = materialize(several.withColumn(NODE, F.monotonically_increasing_id() + F.lit(top + 1)), "repeated-texts")
    least = several.groupBy(ROW).agg(F.min(DIGEST).alias("_stage_least"))  # one text keeps the id itself
    several = several.join(least, ROW).select(ROW, DIGEST, F.when(F.col(DIGEST) == F.col("_stage_least"), F.col(ROW)).otherwise(
        F.col(NODE)).alias(NODE))
    single = docs.join(again, "doc_id", "left_anti").select(*docs.columns, F.col("doc_id").alias(NODE))
    repeated = docs.join(again, "doc_id", "left_semi").select(*docs.columns, digest)
    repeated = repeated.join(several, (repeated["doc_id"] == several[ROW]) & (repeated[DIGEST] == several[DIGEST])).select(
        *[repeated[c] for c in docs.columns], several[NODE]).dropDuplicates([NODE])
    rows = materialize(single.unionByName(repeated), "numbered-documents")
    found = near_duplicates(rows.select(F.col(NODE).alias("doc_id"), "text"), SHINGLE, *SIMILARITY)
    return rows.join(found.where("not kept").select(F.col("doc_id").alias(NODE)), NODE, "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    ship_package(spark)
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("quality classifier", quality), ("minhash near-dedup", near_dedup),
          ("best-fit packing", packing)]

#: SQL cannot express the classifiers; tests/llm/test_pipeline.py checks run() against direct versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
