"""Tree ensembles as a table (ML3, ML6): scored level by level with joins, importances from node gains.

A saved forest is a table of nodes; nothing here calls a model. A row stands
at one node of every tree; each level is a join with the inner nodes, after
which the row stands at a child or stays at its leaf.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Node tables of more rows than this are joined without a broadcast.
MAX_BROADCAST_NODES = 200_000


def forest_nodes(spark: SparkSession, pipeline: str) -> DataFrame:
    """(tree, node, feature, threshold, categories, left, right, stats, gain) of the forest in a saved pipeline.

    Inner nodes have children from 0 on; ``categories`` (of a nominal split)
    or ``threshold`` sends a row left. ``stats`` are the class weights.
    """
    n = F.col("nodeData")
    nominal = n["split"]["numCategories"] >= 0
    values = n["split"]["leftCategoriesOrThreshold"]
    return spark.read.parquet(f"{pipeline}/stages/*RandomForest*/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
        F.when(~nominal, F.try_element_at(values, F.lit(1))).alias("threshold"), F.when(nominal, values).alias("categories"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["impurityStats"].alias("stats"), n["gain"].alias("gain"))


def forest_probability(rows: DataFrame, nodes: DataFrame, depth: int, key: str, features: str = "features") -> DataFrame:
    """(key, p): the mean over trees of class 1's share at the leaf that each row of feature vectors reaches."""
    small = nodes.limit(MAX_BROADCAST_NODES + 1).count() <= MAX_BROADCAST_NODES
    hint = F.broadcast if small else lambda df: df
    inner = nodes.where(F.col("left") >= 0).select("tree", "node", "feature", "threshold", "categories", "left", "right")
    leaves = nodes.where(F.col("left") < 0).select("tree", "node", (F.col("stats")[1] / F.aggregate(
        "stats", F.lit(0.0), lambda a, x: a + x)).alias("share"))
    trees = nodes.agg(F.max("tree")).first()[0] + 1
    at = rows.select(key, vector_to_array(features).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
                     F.lit(0).alias("node"))
    value = F.element_at("x", F.col("feature") + 1)
    goes_left = F.when(F.col("categories").isNotNull(), F.array_contains("categories", value)).otherwise(value <= F.col("threshold"))
    for _ in range(depth):
        at = at.join(hint(inner), ["tree", "node"], "left").select(
            key, "x", "tree", F.when(F.col("feature").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(
                F.col("right")).alias("node"))
    return at.drop("x").join(hint(leaves), ["tree", "node"]).groupBy(key).agg((F.sum("share") / F.lit(float(trees))).alias("p"))


def forest_importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): weighted gains per tree as shares, averaged over trees, as shares."""
    weight = F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    gains = nodes.where(F.col("left") >= 0).groupBy("tree", "feature").agg(F.sum(F.col("gain") * weight).alias("g"))
    share = gains.withColumn("s", F.col("g") / F.nullif(F.sum("g").over(Window.partitionBy("tree")), F.lit(0.0)))
    total = share.groupBy("feature").agg(F.sum("s").alias("s"))  # one row per feature
    return total.select("feature", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias("importance"))
