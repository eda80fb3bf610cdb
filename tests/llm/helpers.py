"""Small inputs with every awkward case."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("score", T.StringType()),
])

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
BASE = " ".join(f"tok{i}" for i in range(60))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    return [
        (1, BASE, "en", "x", 1, "a"), (2, BASE, "en", None, None, None), (2, BASE, "en", None, None, None),
        (3, BASE + " tail", None, "y", 2, "b"), (4, None, "en", "z", 3, "c"), (5, "", "de", "z", 3, "c"),
        (6, " \t\n ", "de", "z", 3, "c"), (7, "two words", "fr", "z", 3, "c"), (8, "two words", "fr", "z", 3, "c"),
        (9, LONG, "en", "z", 3, "c"), (10, LONG + " end", "en", "z", 3, "c"), (None, BASE, "en", "z", 3, "c"),
        (None, None, None, None, None, None), (11, "Ünï ÇÖDÉ <|endoftext|> x　y\x1cz", "es", "z", 3, "c"),
    ]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
