"""Table scans over the parquet test layout and the reference's file formats."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Explicit schema of the order table as the reference writes it (CSV with header).
ORDERS_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("product_category", T.StringType()),
    T.StructField("price_inr", T.DoubleType()),
    T.StructField("discount_pct", T.DoubleType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("customer_tenure_days", T.IntegerType()),
    T.StructField("num_previous_orders", T.IntegerType()),
    T.StructField("num_previous_returns", T.IntegerType()),
    T.StructField("delivery_distance_km", T.DoubleType()),
    T.StructField("delivery_days", T.IntegerType()),
    T.StructField("is_weekend_order", T.IntegerType()),
    T.StructField("rating_given", T.DoubleType()),
    T.StructField("returned", T.IntegerType()),
])

POLICY_SCHEMA = T.StructType([
    T.StructField("document_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
])

CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)


def read_orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: order CSV with header; blank cells are nulls; no inference."""
    return spark.read.schema(ORDERS_SCHEMA).option("header", True).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC2: a JSON file holding one array of flat objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """SRC3/SRC4: image collection as ``(path, modificationTime, length, content)``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
