"""Classification metrics over scored tables ``(…, label, p)``.

Every operator is a bounded number of aggregation passes; none ranks the whole
table in one window:

* confusion cells are one ``agg`` of conditional counts (AGG10-12);
* the threshold sweep buckets each row once against the grid and sums a
  histogram whose size is the grid, not the data (AGG14/15);
* ROC-AUC sums, per distinct score, positives x negatives below it. The
  "below" count is a two-level prefix: ranges of scores (as many as
  partitions) give offsets, and only scores of one range are ordered
  together (AGG13);
* slices are one GROUPING SETS pass (AGG16-18).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import join_null_safe
from ..functions.scoring import safe_div
from ..session import materialize


def _cells(pred, label):
    return [
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(pred & (label == 1), 1)).alias("tp"),
        F.count(F.when(pred & (label == 0), 1)).alias("fp"),
        F.count(F.when(~pred & (label == 1), 1)).alias("fn"),
        F.count(F.when(~pred & (label == 0), 1)).alias("tn"),
    ]


def _rates(df: DataFrame, digits: int = 6) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (df
            .withColumn("accuracy", F.round(safe_div(tp + tn, tp + fp + fn + tn), digits))
            .withColumn("precision", F.round(safe_div(tp, tp + fp), digits))
            .withColumn("recall", F.round(safe_div(tp, tp + fn), digits))
            .withColumn("f1", F.round(safe_div(2 * tp, 2 * tp + fp + fn), digits)))


def confusion_at_threshold(scored: DataFrame, t: float, label: str = "label", p: str = "p",
                           group_cols=()) -> DataFrame:
    """AGG10-12: TP/FP/FN/TN, accuracy, precision, recall, F1 at ``p >= t``."""
    pred = F.col(p) >= F.lit(t)
    agg = scored.groupBy(*group_cols).agg(*_cells(pred, F.col(label)))
    return _rates(agg.withColumn("threshold", F.lit(float(t))))


def grid_position(p, lo: int, hi: int, scale: int):
    """Number of grid points ``i/scale`` (lo <= i <= hi) with ``i/scale <= p``.

    Exact: the floor guess is corrected by comparing with the same doubles the
    grid holds (so 0.47 compares as the double 47/100, like ``p >= 0.47``).
    """
    k0 = F.floor(p * scale)
    i_max = (F.when((k0 + 1) / F.lit(float(scale)) <= p, k0 + 1)
             .when(k0 / F.lit(float(scale)) <= p, k0)
             .otherwise(k0 - 1))
    return F.least(F.greatest(i_max - (lo - 1), F.lit(0)), F.lit(hi - lo + 1)).cast("int")


def threshold_sweep(scored: DataFrame, lo: int = 10, hi: int = 90, scale: int = 100,
                    label: str = "label", p: str = "p", group_cols=()) -> DataFrame:
    """AGG14: P/R/F1 at thresholds lo/scale … hi/scale in one pass.

    NumPy's ``arange`` drifts (0.46999999999999986); the grid here is the
    exact ``i/scale`` double.
    """
    spark = scored.sparkSession
    g = list(group_cols)
    b = grid_position(F.col(p), lo, hi, scale)
    hist = (scored.withColumn("_b", b).groupBy(*g, "_b")
            .agg(F.count(F.when(F.col(label) == 1, 1)).alias("_pos"),
                 F.count(F.when(F.col(label) == 0, 1)).alias("_neg")))
    nb = hi - lo + 1
    # every grid position per group (zero-filled), generated on the distinct
    # group keys: bounded by grid size x number of groups
    keys = hist.select(*g).distinct() if g else spark.range(1).select()
    full = keys.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(nb))))
    full = join_null_safe(full, hist, g + ["_b"], "left").fillna(0, ["_pos", "_neg"])
    w_suffix = Window.partitionBy(*g).orderBy(F.col("_b").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy(*g)
    cum = (full
           .withColumn("tp", F.sum("_pos").over(w_suffix))
           .withColumn("fp", F.sum("_neg").over(w_suffix))
           .withColumn("_P", F.sum("_pos").over(w_all))
           .withColumn("_N", F.sum("_neg").over(w_all)))
    out = (cum.where(F.col("_b") >= 1)
           .select(*g,
                   F.round((F.col("_b") + (lo - 1)) / F.lit(float(scale)), 2).alias("threshold"),
                   "tp", "fp",
                   (F.col("_P") - F.col("tp")).alias("fn"),
                   (F.col("_N") - F.col("fp")).alias("tn")))
    return _rates(out).drop("accuracy")


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """AGG15: arg-max, first (lowest) threshold on ties."""
    return sweep.orderBy(F.col(metric).desc(), F.col("threshold").asc()).limit(1)


def auc_counts(scored: DataFrame, label: str = "label", p: str = "p", group_cols=(),
               n_buckets: int | None = None) -> DataFrame:
    """Exact integer parts of the AUC per group: ``(n_pos, n_neg, num2)``.

    ``num2`` = sum over distinct scores s of pos(s) * (2 neg(< s) + neg(s)), so
    AUC = num2 / (2 n_pos n_neg). Rows with a null or NaN score have no place
    in the order and take no part.

    Distinct scores are dealt into ranges whose bounds come from a sample of
    the scores themselves (range partitioning), so crowded scores are spread
    like any others; ``n_buckets`` is the number of ranges (None: Spark's).
    Only groups that span several ranges have offsets: at most two rows a range.
    """
    g = list(group_cols)
    per_p = (scored.groupBy(*g, p)
             .agg(F.count(F.when(F.col(label) == 1, 1)).alias("_pos"),
                  F.count(F.when(F.col(label) == 0, 1)).alias("_neg")))
    ranges = per_p.repartitionByRange(*([n_buckets] if n_buckets else []), *g, p)
    # scores without a place are dropped from the written table: a filter above the scoring would be pushed
    # below it and score every row again
    per_p = materialize(ranges.withColumn("_bk", F.spark_partition_id()), "auc-scores").where(F.col(p).isNotNull() & ~F.isnan(p))
    per_bucket = per_p.groupBy(*g, "_bk").agg(F.sum("_neg").alias("_bneg"))
    w_b = Window.partitionBy(*g).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*g, "_bk", F.sum("_bneg").over(w_b).alias("_off")).where(F.col("_off") > 0)
    w_p = Window.partitionBy(*g, "_bk").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    contrib = (join_null_safe(per_p.withColumn("_own", F.coalesce(F.sum("_neg").over(w_p), F.lit(0))), F.broadcast(offsets),
                              g + ["_bk"], "left")
               .withColumn("_below", F.coalesce("_off", F.lit(0)) + F.col("_own"))
               .withColumn("_c", F.col("_pos") * (2 * F.col("_below") + F.col("_neg"))))
    return contrib.groupBy(*g).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
                                   F.sum("_c").alias("num2"))


def roc_auc(scored: DataFrame, label: str = "label", p: str = "p", group_cols=(), n_buckets: int | None = None) -> DataFrame:
    """AGG13: exact ROC-AUC with ties counted one half, per group (null without both classes)."""
    c = auc_counts(scored, label, p, group_cols, n_buckets)
    return c.select(*group_cols, "n_pos", "n_neg", F.round(
        F.col("num2") / F.nullif(2 * F.col("n_pos") * F.col("n_neg"), F.lit(0)), 6).alias("roc_auc"))


def slice_metrics(scored: DataFrame, dims, t: float, label: str = "label",
                  p: str = "p") -> DataFrame:
    """AGG17: n, positives, recall and precision per value of each dimension.

    One GROUPING SETS pass; ``grouping_id`` names the dimension so a null
    category is still a legal slice value.
    """
    dims = list(dims)
    m = len(dims)
    pred = F.col(p) >= F.lit(t)
    lab = F.col(label)
    grouped = scored.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(lab == 1, 1)).alias("positives"),
        F.count(F.when(pred, 1)).alias("predicted_positive"),
        F.count(F.when(pred & (lab == 1), 1)).alias("tp"))
    dim_name = None
    value = None
    order = None
    for j, d in enumerate(dims):
        gid = sum(1 << (m - 1 - i) for i in range(m) if i != j)
        cond = F.col("_gid") == gid
        dim_name = (F.when(cond, F.lit(d)) if dim_name is None else dim_name.when(cond, F.lit(d)))
        value = (F.when(cond, F.col(d).cast("string")) if value is None
                 else value.when(cond, F.col(d).cast("string")))
        order = (F.when(cond, F.lit(j)) if order is None else order.when(cond, F.lit(j)))
    return grouped.select(
        dim_name.alias("slice_type"), order.alias("slice_order"), value.alias("slice_value"),
        "n", "positives", "predicted_positive", "tp",
        F.round(safe_div(F.col("tp"), F.col("positives")), 6).alias("recall"),
        F.round(safe_div(F.col("tp"), F.col("predicted_positive")), 6).alias("precision"))


def weakest_slice(slices: DataFrame, metric: str = "recall") -> DataFrame:
    """AGG18 (AGG16 arg-min): lowest metric, ties by dimension order then value."""
    return slices.orderBy(F.col(metric).asc(), F.col("slice_order").asc(),
                          F.col("slice_value").asc_nulls_first()).limit(1)


def per_class_from_confusion(conf: DataFrame, true_col: str = "true_class",
                             pred_col: str = "pred_class", n_col: str = "n") -> DataFrame:
    """AGG20: per-class precision/recall/F1/support from a long confusion table."""
    by_true = conf.groupBy(F.col(true_col).alias("class_id")).agg(
        F.sum(n_col).alias("support"),
        F.sum(F.when(F.col(true_col) == F.col(pred_col), F.col(n_col)).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(F.col(pred_col).alias("class_id")).agg(F.sum(n_col).alias("predicted"))
    j = by_true.join(by_pred, "class_id", "full").fillna(0, ["support", "tp", "predicted"])
    prec = safe_div(F.col("tp"), F.col("predicted"))
    rec = safe_div(F.col("tp"), F.col("support"))
    return j.select(
        "class_id",
        F.round(prec, 6).alias("precision"),
        F.round(rec, 6).alias("recall"),
        F.round(safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")), 6).alias("f1"),
        F.col("support").cast("long").alias("support"))


def top_pairs(conf: DataFrame, n: int, true_col: str = "true_class", pred_col: str = "pred_class",
              n_col: str = "n") -> DataFrame:
    """TOP2: most frequent off-diagonal pairs; ties by (true, pred)."""
    return (conf.where(F.col(true_col) != F.col(pred_col)).where(F.col(n_col) > 0)
            .orderBy(F.col(n_col).desc(), true_col, pred_col).limit(n))


def complete_confusion(pairs: DataFrame, classes: DataFrame, true_col: str = "true_class",
                       pred_col: str = "pred_class") -> DataFrame:
    """AGG19 + JN7: ``(true, pred, n)`` over the full class grid, zero-filled.

    ``classes`` is the (bounded) class list; the grid is built by exploding
    that list twice on one row, not by a join of data.
    """
    counts = pairs.groupBy(true_col, pred_col).agg(F.count(F.lit(1)).alias("n"))
    grid = (classes.agg(F.array_sort(F.collect_set("class_id")).alias("_c"))
            .select(F.explode("_c").alias(true_col), "_c")
            .select(true_col, F.explode("_c").alias(pred_col)))
    return (grid.join(counts, [true_col, pred_col], "left")
            .select(true_col, pred_col, F.coalesce("n", F.lit(0)).alias("n")))
