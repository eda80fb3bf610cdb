"""Sinks: CSV, JSON lines, parquet index tables, model and config artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..artifacts import Artifacts


def write_csv(df: DataFrame, path: str) -> None:
    """SNK1: header CSV, no index column."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_matrix_csv(long_df: DataFrame, row_col: str, col_col: str, value_col: str,
                     labels: list, path: str) -> None:
    """SNK2: long (row, col, value) table pivoted to a labelled matrix.

    ``labels`` is the fixed class list, so the pivot needs no distinct pass.
    """
    wide = (long_df.groupBy(row_col).pivot(col_col, labels).agg(F.sum(value_col))
            .fillna(0).orderBy(row_col))
    write_csv(wide, path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """SNK3: JSON lines."""
    df.write.mode("overwrite").json(path)


def write_index(df: DataFrame, path: str, **options) -> None:
    """SNK4: vector index table, always a full overwrite; ``options`` are the writer's."""
    df.write.mode("overwrite").options(**options).parquet(path)


def write_config(spark: SparkSession, path: str, **values) -> DataFrame:
    """SNK6: one-row configuration artifact (e.g. the tuned threshold)."""
    df = spark.createDataFrame([values])
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """SNK7: add ``(run_id, metric, value)`` rows to a metrics table.

    A (run_id, metric) is one partition and is replaced as a whole, so a
    retried or repeated run leaves one copy and touches no other run.
    """
    (df.select("run_id", "metric", F.col("value").cast("double").alias("value")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "metric").parquet(path))


def cached_table(spark: SparkSession, path: str, build, snapshot: str, version: str = "1") -> DataFrame:
    """SNK8: materialise once per (input snapshot, code version); reuse a committed copy of the same pair.

    A changed input or version builds its own copy beside the old one, so no
    stale rows are served.
    """
    store = Artifacts(spark, path)
    return store.table("table", f"{snapshot}:{version}", build)
