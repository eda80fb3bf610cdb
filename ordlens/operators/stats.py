"""Dataset profile and train-only preprocessing statistics (AGG1-AGG9, ML1 numbers).

Exact medians at scale: Spark's exact ``median`` keeps a value->count map per
group, which for a continuous column grows with the data. :func:`exact_quantiles`
instead narrows a value range with fixed-size histograms (one aggregation
pass per round over all columns at once, each pass returning at most
``targets x bins`` rows), so nothing proportional to the data reaches one task
or the driver.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import safe_div


def present(c: str) -> Column:
    """A column as double, with NaN as missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def exact_kth(df: DataFrame, targets: dict, bins: int = 1024, max_rounds: int = 200) -> dict:
    """k-th smallest (0-based) value for several (column, k) targets; nulls and NaN are missing.

    Infinities are values: they rank before and after all finite ones.

    ``targets`` maps a name to ``(column, k)``. Each round assigns every value
    still inside a target's [lo, hi] to one of ``bins`` equal-width bins and
    keeps the bin holding rank k (by its exact min/max). The min and the max of
    a range always fall in different bins, so every round strictly shrinks the
    candidate set; typical data needs 3-6 rounds.
    """
    cols = sorted({c for c, _ in targets.values()})
    raw = {c: present(c) for c in cols}
    finite = [F.when(F.abs(raw[c]) < float("inf"), raw[c]).alias(c) for c in cols]
    ends = df.agg(*[F.count_if(raw[c] == float("-inf")).alias(f"low_{i}") for i, c in enumerate(cols)])
    work = df.select(*finite).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = work.agg(*[F.min(c).alias(f"mn_{i}") for i, c in enumerate(cols)],
                         *[F.max(c).alias(f"mx_{i}") for i, c in enumerate(cols)],
                         *[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)]).first()
        low = ends.first()
        state, result = {}, {}
        for name, (c, k) in targets.items():
            i = cols.index(c)
            k -= low[f"low_{i}"]
            if k < 0 or k >= first[f"n_{i}"]:
                result[name] = float("-inf") if k < 0 else float("inf")
                continue
            state[name] = {"col": c, "k": k, "lo": first[f"mn_{i}"], "hi": first[f"mx_{i}"], "below": 0}
        for _ in range(max_rounds):
            active = {n: s for n, s in state.items() if n not in result}
            for n, s in list(active.items()):
                if s["lo"] is None or s["lo"] == s["hi"]:
                    result[n] = s["lo"]
                    del active[n]
            if not active:
                break
            # targets of one column that are in the same range (a median's two middle ranks mostly are) share a histogram
            spans = sorted({(s["col"], s["lo"], s["hi"]) for s in active.values()})
            entries = []
            for t, (c, low_end, high_end) in enumerate(spans):
                x = F.col(c)
                lo, hi = F.lit(float(low_end)), F.lit(float(high_end))
                b = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
                entries.append(F.when(x.between(lo, hi), F.struct(F.lit(t).alias("t"), b.alias("b"),
                                                                  x.alias("x"))))
            hist = (work.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
                    .groupBy("e.t", "e.b")
                    .agg(F.count(F.lit(1)).alias("n"), F.min("e.x").alias("mn"), F.max("e.x").alias("mx"))
                    .collect())
            by_t = {}
            for r in hist:
                by_t.setdefault(r["t"], []).append(r)
            for s in active.values():
                acc = s["below"]
                for r in sorted(by_t.get(spans.index((s["col"], s["lo"], s["hi"])), []), key=lambda r: r["b"]):
                    if acc + r["n"] > s["k"]:
                        s["lo"], s["hi"], s["below"] = r["mn"], r["mx"], acc
                        break
                    acc += r["n"]
        else:
            raise RuntimeError("exact_kth did not converge")
        return result
    finally:
        work.unpersist()


def exact_medians(df: DataFrame, cols) -> dict:
    """AGG4: exact interpolated median of each column (nulls and NaN ignored)."""
    counts = df.agg(*[F.count(present(c)).alias(c) for c in cols]).first()
    targets = {}
    for c in cols:
        n = counts[c]
        if n == 0:
            continue
        targets[(c, "a")] = (c, (n - 1) // 2)
        targets[(c, "b")] = (c, n // 2)
    kth = exact_kth(df, targets) if targets else {}
    return {c: (None if counts[c] == 0 else (kth[(c, "a")] + kth[(c, "b")]) / 2.0) for c in cols}


def modes(df: DataFrame, cols) -> DataFrame:
    """AGG5: most frequent value per column, ties to the smallest value.

    A per-value count (map-side combined) then an arg-max over the small
    per-value table: no per-group value map in one task.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                     F.col(c).cast("string").alias("value"))
                                            for c in cols])).alias("s")).select("s.*")
    counts = stacked.where(F.col("value").isNotNull()).groupBy("column", "value").count()
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("count")).alias("neg"), F.col("value").alias("v"))).alias("mode"))


def impute_stats(train: DataFrame, numeric, categorical) -> DataFrame:
    """ML1 statistics on the training rows: median, then mean and population
    std of the median-imputed column (the scaler sees imputed values), and the
    mode of each categorical."""
    spark = train.sparkSession
    med = exact_medians(train, numeric)
    imputed = [F.coalesce(present(c), F.lit(med[c])) for c in numeric]
    moments = train.agg(*[F.avg(e).alias(f"mean_{i}") for i, e in enumerate(imputed)],
                        *[F.stddev_pop(e).alias(f"std_{i}") for i, e in enumerate(imputed)])
    num_rows = moments.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit("numeric").alias("kind"),
                 F.lit(med[c]).cast("double").alias("median"),
                 F.col(f"mean_{i}").alias("mean"), F.col(f"std_{i}").alias("std"),
                 F.lit(None).cast("string").alias("mode"))
        for i, c in enumerate(numeric)])).alias("r")).select("r.*")
    cat_rows = modes(train, categorical).select(
        "column", F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("median"),
        F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"), "mode")
    out = num_rows.unionByName(cat_rows)
    return out.select("column", "kind", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std")], "mode")


def profile(df: DataFrame, label: str) -> DataFrame:
    """AGG1/AGG2: rows, columns, positive rate, share of nulls per column."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.round(F.avg(F.col(label).cast("double")), 6).alias("positive_rate"),
        *[F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(f"missing_{c}") for c in df.columns])


def vocabulary(train: DataFrame, categorical) -> DataFrame:
    """AGG7: category vocabulary in alphabetical order with train counts."""
    stacked = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                        F.col(c).cast("string").alias("value"))
                                               for c in categorical])).alias("s")).select("s.*")
    counts = stacked.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n_train"))
    return counts.withColumn("idx", (F.row_number().over(
        Window.partitionBy("column").orderBy("value")) - 1).cast("int"))


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """AGG8: balanced weights n / (k * n_c)."""
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return c.select(label, "n", (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))


def majority_baseline(split_df: DataFrame, label: str) -> DataFrame:
    """AGG9: predict the train majority class (ties: smallest) on test."""
    train = split_df.where(F.col("split") == "train")
    test = split_df.where(F.col("split") == "test")
    # fitting the baseline = one value (the majority class), like any model fit
    majority = (train.groupBy(label).count()
                .agg(F.min_by(label, F.struct((-F.col("count")).alias("neg"), F.col(label).alias("v"))))
                .first()[0])  # null without training rows: then nothing is predicted right
    y = F.col(label)
    m = F.lit(majority)
    agg = test.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count(F.when(y == m, 1)).alias("correct"),
        F.count(F.when((y == 1) & (m == 1), 1)).alias("tp"),
        F.count(F.when((y == 0) & (m == 1), 1)).alias("fp"),
        F.count(F.when((y == 1) & (m == 0), 1)).alias("fn"))
    return agg.select(m.cast("int").alias("majority"), "n_test",
                      F.round(safe_div(F.col("correct"), F.col("n_test")), 6).alias("accuracy"),
                      F.round(safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)
                      .alias("f1"))
