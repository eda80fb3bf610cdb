"""Byte-bounded shards by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a row's hash. A bucket whose
rows exceed the byte limit splits on its next bit; the others stay. The first
60 bits come from the key; a bucket of one key that is still too large goes on
with bits of the row's own number, so every bucket can split down to one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordlens.session import materialize

#: Bits of the key's hash, and as many of the row number's.
WIDTH = 60
#: Directory levels that one round looks below the expected depth.
AHEAD = 6
#: Directory bits that one round of the climb covers.
STEP = 5


def _bits(text: Column) -> Column:
    """The first 60 bits of the md5 as a string of 0 and 1."""
    return F.lpad(F.bin(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")), WIDTH, "0")


def extendible_shards(docs: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, shard, depth, shard_bytes, shard_rows.

    ``shard`` is the bucket's hash prefix ('' if one shard holds all). No
    shard exceeds ``limit_bytes`` unless it is one single row of more bytes.
    Null keys hash as the empty string, null and empty texts have 0 bytes,
    equal keys share their first 60 bits, columns other than key and text are
    ignored; an empty table gives an empty result.
    """
    slim = materialize(docs.select(
        F.col(key).alias("k"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(WIDTH, math.ceil(math.log2(max(total / limit_bytes, 1))) + AHEAD)
    own = _bits(F.coalesce(F.col("k").cast("string"), F.lit("")))
    rest, done, above = slim, [], 0
    while True:
        bits = own if depth <= WIDTH else F.concat(own, _bits(F.concat(F.lit("row "), F.col("row").cast("string"))))
        rows = rest.withColumn("cell", F.substring(bits, 1, depth))
        directory = materialize(_leaves(rows, depth, above, limit_bytes), "shard-directory")
        placed = rows.join(directory.where("depth is not null"), "cell")
        done.append(placed.select("k", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"))
        large = directory.where("depth is null").select("cell")
        if large.isEmpty():
            break
        rest = materialize(rows.join(large, "cell", "left_semi").drop("cell"), "shard-rows")
        above, depth = depth, min(depth + 2 * AHEAD, 2 * WIDTH)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("k", key)


def _leaves(rows: DataFrame, depth: int, above: int, limit: int) -> DataFrame:
    """Every cell of ``depth`` bits with its leaf bucket, or nulls if the cell itself must split.

    The directory is climbed ``STEP`` bits a round: a round sums the nodes
    below one ancestor, at most ``2**STEP`` of them, and goes on with the
    ancestors alone, up to ``above`` bits, where no bucket is known to fit (0:
    the whole table). A node whose ancestor fits takes that ancestor's leaf.
    """
    cells = rows.groupBy(F.col("cell").alias("node")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r"))
    rounds, low = [], depth
    while True:
        high = max(low - STEP, above)
        rounds.append(materialize(_climb(cells, low, high, limit, low == depth >= 2 * WIDTH), "shard-round"))
        if high == above:
            break
        cells = rounds[-1].groupBy(F.col("top").alias("node")).agg(F.max("top_b").alias("b"), F.max("top_r").alias("r"))
        low = high
    found = rounds.pop().select("node", "leaf")
    while rounds:
        below = rounds.pop()
        upper = found.select(F.col("node").alias("top"), F.col("leaf").alias("upper"))
        found = below.join(upper, "top").select("node", F.when(F.col("rises"), F.col("upper")).otherwise(F.col("leaf")).alias("leaf"))
    return found.select(F.col("node").alias("cell"), "leaf.*")


def _climb(cells: DataFrame, low: int, high: int, limit: int, last: bool) -> DataFrame:
    """Nodes of ``low`` bits with the largest bucket that holds them and fits, looked for down from ``high`` bits.

    (node, top, top_b, top_r, rises, leaf): the ancestor of ``high`` bits with
    its sums, whether that one fits and may grow, the bucket (null if the node
    itself does not fit; the node as it is at the ``last`` bit).
    """
    d = cells.withColumn("top", F.substring("node", 1, high)).repartition("top")
    for at in range(high, low):
        same = Window.partitionBy("top", F.substring("node", 1, at))
        d = d.withColumn(f"b{at}", F.sum("b").over(same)).withColumn(f"r{at}", F.sum("r").over(same))
    d = d.withColumn(f"b{low}", F.col("b")).withColumn(f"r{low}", F.col("r"))

    def fits(at: int) -> Column:
        return (F.col(f"b{at}") <= limit) | (F.col(f"r{at}") == 1)

    def bucket(at: int) -> Column:
        return F.struct(F.lit(at).alias("depth"), F.substring("node", 1, at).alias("shard"),
                        F.col(f"b{at}").alias("shard_bytes"), F.col(f"r{at}").alias("shard_rows"))

    found = [F.when(fits(at), bucket(at)) for at in range(high, low + 1)]
    return d.select("node", "top", F.col(f"b{high}").alias("top_b"), F.col(f"r{high}").alias("top_r"),
                    fits(high).alias("rises"), F.coalesce(*found, *([bucket(low)] if last else [])).alias("leaf"))
