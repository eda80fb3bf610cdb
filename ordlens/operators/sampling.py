"""Exact, deterministic splitting: stratified split, folds, value shuffles.

Everything rests on :func:`ranked_within`, an exact 1-based rank of each row
inside its class in a seeded hash order. It never builds one window partition
per class (a class can hold most of the data): rows are spread over
``2**bucket_bits`` hash buckets per class, bucket sizes (a table bounded by
classes x buckets) give prefix offsets, and only rows of one (class, bucket)
are sorted together. The rows, wide as they are, are shuffled once: the window
and the join with the offsets share one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import join_null_safe


def seeded_hash(seed, key_cols) -> Column:
    """First 32 bits of md5("seed:key") as a non-negative long."""
    parts = [F.lit(str(seed)), F.lit(":")]
    for i, k in enumerate(key_cols):
        if i:
            parts.append(F.lit(":"))
        parts.append(F.col(k).cast("string"))
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("long")


def ranked_within(df: DataFrame, class_cols, key_cols, seed, out: str = "rank_in_class",
                  bucket_bits: int = 16) -> DataFrame:
    """Exact rank per class in (hash, key) order; adds ``out`` (1-based)."""
    cls = list(class_cols)
    keys = list(key_cols)
    shift = 32 - bucket_bits
    h = df.withColumn("_h", seeded_hash(seed, keys)).withColumn("_hb", F.shiftright("_h", shift))
    sizes = h.groupBy(*cls, "_hb").agg(F.count(F.lit(1)).alias("_bn"))
    w_off = Window.partitionBy(*cls).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*cls, "_hb", F.coalesce(F.sum("_bn").over(w_off), F.lit(0)).alias("_off"),
                           F.sum("_bn").over(Window.partitionBy(*cls)).alias("class_size"))
    # offsets holds at most (number of classes) x 2**bucket_bits rows; no
    # broadcast hint: AQE broadcasts it at run time when its measured size is
    # under the threshold (always, for a label column) and shuffles otherwise
    # (class, bucket) as a struct: null classes are equal in it, and the join needs no other dealing than the window's
    group = F.struct(*cls, "_hb").alias("_g")
    own = h.select("*", group).drop("_hb").withColumn(
        "_own", F.row_number().over(Window.partitionBy("_g").orderBy("_h", *keys)))
    return (own.join(offsets.select(group, "_off", "class_size"), "_g")
            .select(*df.columns, "class_size", (F.col("_off") + F.col("_own")).alias(out)))


def test_quota(class_size: Column, test_fraction: float) -> Column:
    """Test rows per class: round-half-up of fraction x class size."""
    return F.floor(class_size * F.lit(test_fraction) + F.lit(0.5))


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """WIN6: adds ``split`` ('train'/'test'); exact per-class quotas."""
    r = ranked_within(df, [label], [key], seed)
    return (r.withColumn("split", F.when(F.col("rank_in_class") <= test_quota(F.col("class_size"), test_fraction),
                                         "test").otherwise("train"))
            .drop("class_size"))


def stratified_split_sized(df: DataFrame, label: str, key: str, n_test: int, seed: int = 42) -> DataFrame:
    """WIN6 with a fixed number of test rows: adds ``split``.

    Every class gets its proportional share of ``n_test`` rounded down; the
    rows left over go one each to the classes with the largest remainders
    (ties: the smaller class value).
    """
    r = ranked_within(df, [label], [key], seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    all_ = Window.partitionBy()
    share = F.lit(n_test).cast("double") * F.col("_c") / F.sum("_c").over(all_)
    quota = sizes.withColumn("_q", F.floor(share)).withColumn("_rem", share - F.floor(share)).withColumn(
        "_left", F.lit(n_test) - F.sum("_q").over(all_)).withColumn(
        "_o", F.row_number().over(Window.orderBy(F.col("_rem").desc(), label)))  # one row per class
    quota = quota.select(label, (F.col("_q") + (F.col("_o") <= F.col("_left")).cast("int")).alias("_quota"))
    return (join_null_safe(r, quota, [label]).withColumn(
        "split", F.when(F.col("rank_in_class") <= F.col("_quota"), "test").otherwise("train"))
        .drop("class_size", "_quota"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 7) -> DataFrame:
    """WIN7: adds ``fold`` in [0, k); per-class fold sizes differ by at most one."""
    r = ranked_within(df, [label], [key], seed, out="_r")
    return r.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r", "class_size")


def permutation_pairs(df: DataFrame, key: str, repeats: int, seed: int = 1000,
                      group_cols=()) -> DataFrame:
    """WIN8: ``(repeat, key, donor_key)``: for each repeat a seeded permutation.

    The row holding position q in the base order takes the values of the row
    holding position q in the order of repeat r; positions come from
    :func:`ranked_within`, so the mapping is exact and skew-safe, and the join
    is an equi-join on (group, repeat, position).
    """
    gg = list(group_cols) or ["_g0"]
    work = df.select(key, *group_cols) if group_cols else df.select(key).withColumn("_g0", F.lit(0))
    base = ranked_within(work, gg, [key], seed, out="_pos").drop("class_size")
    reps = base.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    perm = ranked_within(reps.drop("_pos"), gg + ["repeat"], ["repeat", key], seed + 1,
                         out="_pos").drop("class_size")
    receivers = reps.select(*gg, "repeat", key, "_pos")
    donors = perm.select(*gg, "repeat", "_pos", F.col(key).alias("donor_key"))
    return receivers.join(donors, gg + ["repeat", "_pos"]).select("repeat", key, "donor_key", *group_cols)
