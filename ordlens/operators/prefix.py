"""Ordered blocks: the base of running values per key that no hot key puts into one task.

Rows are dealt into ranges of (key, order, tie) whose bounds Spark samples
from the data; callers write the result before they use it twice. A range
holds about its share of the rows, whatever the keys and the order values are:
a key with a third of all rows, or one whose rows all carry the same or no
order value, spans many ranges. A window over (key, block) then meets one range at most, and the
summary has one row per key and range it spans.

Rows that are equal in every column stay in one range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, TIE = "_block", "_tie"


def ordered_blocks(df: DataFrame, key: str, order: str, tie: str | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with ``BLOCK``, the number of a row's range, and ``TIE``, which orders rows of equal (key, order).

    Ranges grow with (key, order, tie), nulls first. ``tie`` names a column
    that settles ties; without one it is a hash of the whole row. ``rows`` aims
    at so many rows in a range; without it there are as many ranges as the
    session has shuffle partitions.
    """
    d = df.withColumn(TIE, F.col(tie) if tie else F.xxhash64(*df.columns))
    number = [] if rows is None else [max(1, math.ceil(df.count() / rows))]
    return d.repartitionByRange(*number, key, order, TIE).withColumn(BLOCK, F.spark_partition_id())
