"""Connected components over an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlens.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node with an edge: (node, label).

    ``edges`` has long columns a, b; edges of a node to itself do not count.
    Each round every node takes the smallest id among itself and its
    neighbours (an aggregate that combines map-side, so a hub is no hot task),
    then the choice of its choice (pointer jumping); edges are contracted to
    these ids and only distinct ones between different ids go on, so rounds
    shrink fast. Rounds are written as parquet in the shared folder, so
    lineage stays short. An empty edge table gives an empty result.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = materialize(both.where("a <> b").distinct(), "cc-edges")
    rounds = []
    while not rounds or not left.isEmpty():
        least = left.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = least.select(F.col("node").alias("m"), F.col("m").alias("label"))
        chosen = materialize(least.join(up, "m").select("node", "label"), "cc-round")
        rounds.append(chosen)
        ends = [chosen.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("a", "b")]
        left = materialize(left.join(ends[0], "a").join(ends[1], "b").where("la <> lb").select(
            F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "cc-edges")
    labels = rounds.pop()
    while rounds:
        labels = rounds.pop().join(labels.toDF("label", "top"), "label", "left").select(
            "node", F.coalesce("top", "label").alias("label"))
    return materialize(labels, "cc-labels")
