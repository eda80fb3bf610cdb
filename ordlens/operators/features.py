"""Order-feature adapter: TPC-H-style base tables -> one row per order.

Plan shape (one shuffle of lineitem by order key, dimension lookups left to
Catalyst/AQE, and a skew-safe running count per customer):

* line aggregates and the top line are one hash/sort aggregate on
  ``l_orderkey`` with map-side partial aggregation, so an order with a huge
  number of lines never lands in one task unaggregated;
* ``part``/``supplier``/``customer`` are plain equi-joins; Spark broadcasts
  them only when its size statistics are under the broadcast threshold,
  otherwise it shuffles (and AQE splits skewed keys);
* prior-order counts per customer use :func:`prior_counts`, which never puts a
  whole customer into one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import join_null_safe
from ..session import materialize
from .prefix import BLOCK, TIE, ordered_blocks

FEATURES_NUMERIC = [
    "price_inr", "discount_pct", "customer_tenure_days", "num_previous_orders",
    "num_previous_returns", "delivery_distance_km", "delivery_days",
    "is_weekend_order", "rating_given",
]
FEATURES_CATEGORICAL = ["product_category", "payment_method"]
# Column order the risk tool expects (VAL1 reports missing names in this order).
FEATURE_ORDER = [
    "product_category", "price_inr", "discount_pct", "payment_method",
    "customer_tenure_days", "num_previous_orders", "num_previous_returns",
    "delivery_distance_km", "delivery_days", "is_weekend_order", "rating_given",
]
LABEL = "returned"
KEY = "order_id"


def line_aggregates(lineitem: DataFrame) -> DataFrame:
    """Per-order line statistics and the top line (highest price, then keys)."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey",
                         "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    # top line = largest (price, then smallest partkey, suppkey); lines that are equal in these give the same keys.
    # The struct is the whole buffer, so the aggregate stays map-side combined and its rows narrow
    top = F.max(F.struct(F.col("l_extendedprice").alias("price"), (-F.col("l_partkey")).alias("partkey"),
                         (-F.col("l_suppkey")).alias("suppkey")))
    return li.groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("price_inr"),
        F.round(F.avg("l_discount") * 100, 4).alias("discount_pct"),
        F.min("l_shipdate").alias("first_ship"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_returned_lines"),
        top.alias("_top"),
    ).withColumn("top", F.struct((-F.col("_top.partkey")).alias("partkey"), (-F.col("_top.suppkey")).alias("suppkey"))).drop("_top")


def prior_counts(df: DataFrame, key: str, ts: str, tiebreak: str, value: str,
                 out_count: str, out_sum: str, out_first: str) -> DataFrame:
    """Running count and sum of earlier rows per ``key`` ordered by (ts, tiebreak), and the key's first day.

    Rows are dealt into ranges of (key, ts, tiebreak) and written once
    (:func:`.prefix.ordered_blocks`); counts and sums of a key's earlier
    ranges are added to those inside a row's own. A key holding a third of all
    rows, on one day or on many, is spread over its ranges. Ranges follow each
    other, so the keys that span several have at most two rows a range in the
    offsets: a broadcast at any size, and the rows are shuffled once.
    """
    d = materialize(ordered_blocks(df, key, ts, tiebreak), "order-core")
    per_block = d.groupBy(key, BLOCK).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), F.min(F.to_date(ts)).alias("_day"))
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        key, BLOCK,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off_s"),
        F.min("_day").over(Window.partitionBy(key)).alias("_first"),
        F.count(F.lit(1)).over(Window.partitionBy(key)).alias("_ranges")).where(F.col("_ranges") > 1)
    inside = Window.partitionBy(key, BLOCK).orderBy(ts, TIE)
    own = (d.withColumn("_own_n", F.row_number().over(inside) - 1)
           .withColumn("_own_s", F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("_own_day", F.min(F.to_date(ts)).over(Window.partitionBy(key, BLOCK))))
    none = F.lit(0)
    return (join_null_safe(own, F.broadcast(offsets), [key, BLOCK], "left")
            .withColumn(out_count, (F.coalesce("_off_n", none) + F.col("_own_n")).cast("int"))
            .withColumn(out_sum, (F.coalesce("_off_s", none) + F.col("_own_s")).cast("int"))
            .withColumn(out_first, F.coalesce("_first", "_own_day"))
            .drop(BLOCK, TIE, "_off_n", "_off_s", "_first", "_ranges", "_own_n", "_own_s", "_own_day"))


def order_features(orders: DataFrame, lineitem: DataFrame, part: DataFrame,
                   supplier: DataFrame, customer: DataFrame) -> DataFrame:
    """D1 order table built from the base tables (FIXTURES section 2).

    The prior-order counts need only the order core (customer, date, label),
    so they run before the dimension lookups. :func:`prior_counts` writes the
    core (one row per order) once: lineitem is scanned and shuffled a single
    time.
    """
    la = line_aggregates(lineitem)
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    core = (la.join(o, la.l_orderkey == o.o_orderkey)
            .select(F.col("o_orderkey").alias(KEY), "o_custkey", "o_orderdate", "o_orderpriority",
                    "price_inr", "discount_pct", "first_ship", "top",
                    (F.col("n_returned_lines") * 2 > F.col("n_lines")).cast("int").alias(LABEL)))
    with_prior = prior_counts(core, "o_custkey", "o_orderdate", KEY, LABEL,
                              "num_previous_orders", "num_previous_returns", "_first_day")
    full = (with_prior
            .join(part.select("p_partkey", "p_type"), F.col("top.partkey") == F.col("p_partkey"))
            .join(supplier.select("s_suppkey", "s_nationkey"), F.col("top.suppkey") == F.col("s_suppkey"))
            .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")))
    return full.select(
        KEY,
        F.col("p_type").alias("product_category"),
        "price_inr", "discount_pct",
        F.col("o_orderpriority").alias("payment_method"),
        F.datediff(F.to_date("o_orderdate"), F.col("_first_day")).cast("int").alias("customer_tenure_days"),
        "num_previous_orders", "num_previous_returns",
        (F.abs(F.col("c_nationkey") - F.col("s_nationkey")) * 100).cast("double").alias("delivery_distance_km"),
        ((F.abs(F.datediff(F.to_date("first_ship"), F.to_date("o_orderdate"))) % 21) + 1)
        .cast("int").alias("delivery_days"),
        F.dayofweek("o_orderdate").isin(1, 7).cast("int").alias("is_weekend_order"),
        F.when(F.col(KEY) % 8 == 0, F.lit(None).cast("double"))
        .otherwise((F.col(KEY) % 5 + 1).cast("double")).alias("rating_given"),
        LABEL)


def validate_required(df: DataFrame, required=FEATURE_ORDER, nullable=("rating_given",)) -> DataFrame:
    """VAL1: add ``missing`` (array of required names that are null, in order).

    Nullable fields are checked for schema presence only: a missing column
    raises at analysis time; a null cell reaches the imputer.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError("Missing required order features: " + ", ".join(absent))
    checks = [F.when(F.col(c).isNull(), F.lit(c)) for c in required if c not in nullable]
    return df.withColumn("missing", F.array_compact(F.array(*checks)))


def split_valid(df: DataFrame, required=FEATURE_ORDER, nullable=("rating_given",)):
    """Valid rows and rejects (with the error text) from :func:`validate_required`."""
    v = validate_required(df, required, nullable)
    good = v.where(F.size("missing") == 0).drop("missing")
    bad = (v.where(F.size("missing") > 0)
           .withColumn("error", F.concat(F.lit("Missing required order features: "),
                                         F.array_join("missing", ", "))))
    return good, bad
