"""Order queries: feature table, scorecard, metrics, slices, splits, statistics.

Each query rebuilds what it needs from the five base tables, so its work
grows with them; the SQL oracle repeats the same CTEs in DuckDB syntax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..artifacts import Artifacts, snapshot
from ..functions import scoring as S
from ..operators import features as FT
from ..operators import metrics as M
from ..operators import sampling as SM
from ..operators import stats as ST
from ..sources.tables import Tables
from .registry import query

# ---- data roles for the TPC-H-style test tables -------------------------
# ``o_orderpriority`` plays the payment method and '1-URGENT' plays COD;
# ``p_type`` plays the product category, two of its values the fit-risk
# categories. Threshold values are the reference's fixed ones.
COD = "1-URGENT"
FIT_RISK = ("PROMO", "STANDARD")
T_DEFAULT = 0.5
T_STAR = S.RISK_THRESHOLD
SPLIT_SEED = 42
FOLD_SEED = 7
PERM_SEED = 1000
PERM_REPEATS = 10
SLICE_DIMS = ["product_category", "payment_method"]
# --------------------------------------------------------------------------


BASE_TABLES = ("orders", "lineitem", "part", "supplier", "customer")


def order_features(spark, sf_dir) -> DataFrame:
    """The feature table, built once per version of its five base tables."""
    t = Tables(spark, sf_dir)
    return Artifacts(spark).table("order-features", snapshot(spark, sf_dir, BASE_TABLES), lambda: FT.order_features(
        t.orders, t.lineitem, t.part, t.supplier, t.customer))


def scored(spark, sf_dir) -> DataFrame:
    """Scored orders ``(order_id, label, p, product_category, payment_method)``."""
    f = order_features(spark, sf_dir)
    return f.select(
        "order_id", F.col("returned").alias("label"),
        S.sigmoid(S.scorecard_logit(FIT_RISK, COD)).alias("p"),
        "product_category", "payment_method")


def split_features(spark, sf_dir) -> DataFrame:
    return SM.stratified_split(order_features(spark, sf_dir), "returned", "order_id", 0.2, SPLIT_SEED)


def split_features_table(spark, sf_dir) -> DataFrame:
    """:func:`split_features` as a table, for queries that read it several times (fits, statistics)."""
    return Artifacts(spark).table("order-split", snapshot(spark, sf_dir, BASE_TABLES), lambda: split_features(spark, sf_dir),
                                  fraction=0.2, seed=SPLIT_SEED)


# ---------------------------------------------------------------- SQL ---
SQL_FEATURES = """
li AS (
  SELECT l_orderkey,
         round(sum(l_extendedprice), 2) AS price_inr,
         round(avg(l_discount) * 100, 4) AS discount_pct,
         min(l_shipdate) AS first_ship,
         count(*) AS n_lines,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_ret
  FROM lineitem GROUP BY l_orderkey),
top AS (
  SELECT l_orderkey, l_partkey, l_suppkey FROM (
    SELECT l_orderkey, l_partkey, l_suppkey,
           row_number() OVER (PARTITION BY l_orderkey
                              ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rn
    FROM lineitem) WHERE rn = 1),
base AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey, o.o_orderdate,
         p.p_type AS product_category, li.price_inr, li.discount_pct,
         o.o_orderpriority AS payment_method,
         CAST(100 * abs(c.c_nationkey - s.s_nationkey) AS DOUBLE) AS delivery_distance_km,
         CAST(abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(li.first_ship AS DATE))) % 21 + 1
              AS INTEGER) AS delivery_days,
         CAST(isodow(o.o_orderdate) IN (6, 7) AS INTEGER) AS is_weekend_order,
         CASE WHEN o.o_orderkey % 8 = 0 THEN NULL ELSE CAST(o.o_orderkey % 5 + 1 AS DOUBLE) END
              AS rating_given,
         CAST(2 * li.n_ret > li.n_lines AS INTEGER) AS returned
  FROM li
  JOIN orders o ON o.o_orderkey = li.l_orderkey
  JOIN top ON top.l_orderkey = li.l_orderkey
  JOIN part p ON p.p_partkey = top.l_partkey
  JOIN supplier s ON s.s_suppkey = top.l_suppkey
  JOIN customer c ON c.c_custkey = o.o_custkey),
order_features AS (
  SELECT order_id, product_category, price_inr, discount_pct, payment_method,
         CAST(date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey),
                        CAST(o_orderdate AS DATE)) AS INTEGER) AS customer_tenure_days,
         CAST(count(*) OVER w AS INTEGER) AS num_previous_orders,
         CAST(coalesce(sum(returned) OVER w, 0) AS INTEGER) AS num_previous_returns,
         delivery_distance_km, delivery_days, is_weekend_order, rating_given, returned
  FROM base
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, order_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

SQL_SCORED = SQL_FEATURES + f""",
z AS (SELECT *, {S.scorecard_sql(FIT_RISK, COD)} AS logit FROM order_features),
scored AS (
  SELECT order_id, returned AS label, 1.0 / (1.0 + exp(-logit)) AS p, product_category, payment_method
  FROM z)"""

SQL_SPLIT = SQL_FEATURES + f""",
hashed AS (
  SELECT *, ('0x' || substr(md5('{SPLIT_SEED}:' || CAST(order_id AS VARCHAR)), 1, 8))::BIGINT AS h
  FROM order_features),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY returned ORDER BY h, order_id) AS rank_in_class,
         count(*) OVER (PARTITION BY returned) AS class_size
  FROM hashed),
split AS (
  SELECT * EXCLUDE (h, class_size),
         CASE WHEN rank_in_class <= floor(CAST(class_size AS DOUBLE) * 0.2 + 0.5) THEN 'test' ELSE 'train' END
         AS split
  FROM ranked)"""


def _with(body: str, cte: str = SQL_FEATURES) -> str:
    return "WITH " + cte + "\n" + body


# ------------------------------------------------------------ queries ---
@query("order_features", _with("SELECT * FROM order_features"))
def q_order_features(spark, sf_dir):
    return order_features(spark, sf_dir)


@query("dataset_profile", _with(
    "SELECT count(*) AS n_rows, 13 AS n_columns, round(avg(CAST(returned AS DOUBLE)), 6) AS positive_rate, "
    + ", ".join(f"round(avg(CAST({c} IS NULL AS DOUBLE)), 6) AS missing_{c}"
                for c in ["order_id"] + FT.FEATURE_ORDER + ["returned"])
    + " FROM order_features"))
def q_dataset_profile(spark, sf_dir):
    f = order_features(spark, sf_dir).select("order_id", *FT.FEATURE_ORDER, "returned")
    return ST.profile(f, "returned").withColumn("n_columns", F.lit(13))


@query("scorecard", _with("SELECT order_id, label, round(p, 6) AS p, product_category, payment_method "
                          "FROM scored", SQL_SCORED))
def q_scorecard(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("p", F.round("p", 6))


@query("risk_buckets", _with(
    f"""SELECT order_id, round(p, 4) AS predicted_return_probability,
       CASE WHEN p < {T_STAR} THEN 'Low' WHEN p < {T_STAR} + {S.MEDIUM_BAND} THEN 'Medium' ELSE 'High' END
       AS risk_bucket
    FROM scored""", SQL_SCORED))
def q_risk_buckets(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("order_id", F.round("p", 4).alias("predicted_return_probability"),
                    S.risk_bucket(F.col("p")).alias("risk_bucket"))


_lo, _hi = f"{T_STAR:.4f}", f"{T_STAR + S.MEDIUM_BAND:.4f}"


@query("cut_points", _with(
    f"""SELECT CAST({T_STAR} AS DOUBLE) AS t_rf, 'probability < {_lo}' AS cut_low,
       '{_lo} <= probability < {_hi}' AS cut_medium, 'probability >= {_hi}' AS cut_high,
       count(*) FILTER (WHERE p < {T_STAR}) AS n_low,
       count(*) FILTER (WHERE p >= {T_STAR} AND p < {T_STAR} + {S.MEDIUM_BAND}) AS n_medium,
       count(*) FILTER (WHERE p >= {T_STAR} + {S.MEDIUM_BAND}) AS n_high
    FROM scored""", SQL_SCORED))
def q_cut_points(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("b", S.risk_bucket(F.col("p")))
    cp = S.cut_points()
    return s.agg(
        F.lit(T_STAR).alias("t_rf"),
        cp["low"].alias("cut_low"), cp["medium"].alias("cut_medium"), cp["high"].alias("cut_high"),
        F.count(F.when(F.col("b") == "Low", 1)).alias("n_low"),
        F.count(F.when(F.col("b") == "Medium", 1)).alias("n_medium"),
        F.count(F.when(F.col("b") == "High", 1)).alias("n_high"))


_CELLS_SQL = """count(*) FILTER (WHERE p >= {t} AND label = 1) AS tp,
       count(*) FILTER (WHERE p >= {t} AND label = 0) AS fp,
       count(*) FILTER (WHERE p < {t} AND label = 1) AS fn,
       count(*) FILTER (WHERE p < {t} AND label = 0) AS tn"""

_RATES_SQL = """round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


@query("confusion_at_threshold", _with(
    f"""SELECT n, tp, fp, fn, tn, threshold, {_RATES_SQL} FROM (
      SELECT count(*) AS n, {_CELLS_SQL.format(t=T_DEFAULT)}, CAST({T_DEFAULT} AS DOUBLE) AS threshold
      FROM scored)""",
    SQL_SCORED))
def q_confusion(spark, sf_dir):
    return M.confusion_at_threshold(scored(spark, sf_dir), T_DEFAULT)


SQL_SWEEP = SQL_SCORED + """,
grid AS (SELECT i, i / 100.0 AS t FROM range(10, 91) r(i)),
sweep AS (
  SELECT round(g.t, 2) AS threshold,
         count(*) FILTER (WHERE s.p >= g.t AND s.label = 1) AS tp,
         count(*) FILTER (WHERE s.p >= g.t AND s.label = 0) AS fp,
         count(*) FILTER (WHERE s.p < g.t AND s.label = 1) AS fn,
         count(*) FILTER (WHERE s.p < g.t AND s.label = 0) AS tn
  FROM grid g, scored s GROUP BY g.t),
sweep_rates AS (
  SELECT threshold, tp, fp, fn, tn,
         round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
         round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
         round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
  FROM sweep)"""


@query("threshold_sweep", _with("SELECT * FROM sweep_rates", SQL_SWEEP))
def q_sweep(spark, sf_dir):
    return M.threshold_sweep(scored(spark, sf_dir))


@query("best_threshold", _with("SELECT * FROM sweep_rates ORDER BY f1 DESC, threshold ASC LIMIT 1", SQL_SWEEP))
def q_best_threshold(spark, sf_dir):
    return M.best_threshold(M.threshold_sweep(scored(spark, sf_dir)))


SQL_AUC_BODY = """, per_p AS (
  SELECT {g}p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM {src} GROUP BY {g}p),
cum AS (
  SELECT {g}pos, neg, coalesce(sum(neg) OVER (PARTITION BY {gp} ORDER BY p
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM per_p)"""


@query("roc_auc", _with(
    """SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       round(sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc FROM cum""",
    SQL_SCORED + SQL_AUC_BODY.format(g="", gp="1", src="scored")))
def q_roc_auc(spark, sf_dir):
    return M.roc_auc(scored(spark, sf_dir))


SQL_SLICES = SQL_SCORED + f""",
slices AS (
  SELECT 'product_category' AS slice_type, 0 AS slice_order, product_category AS slice_value,
         count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives,
         count(*) FILTER (WHERE p >= {T_STAR}) AS predicted_positive,
         count(*) FILTER (WHERE p >= {T_STAR} AND label = 1) AS tp
  FROM scored GROUP BY product_category
  UNION ALL
  SELECT 'payment_method', 1, payment_method,
         count(*), count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE p >= {T_STAR}),
         count(*) FILTER (WHERE p >= {T_STAR} AND label = 1)
  FROM scored GROUP BY payment_method),
slice_rates AS (
  SELECT *, round(coalesce(tp / nullif(positives, 0), 0), 6) AS recall,
         round(coalesce(tp / nullif(predicted_positive, 0), 0), 6) AS precision
  FROM slices)"""


@query("slice_metrics", _with("SELECT * FROM slice_rates", SQL_SLICES))
def q_slice_metrics(spark, sf_dir):
    return M.slice_metrics(scored(spark, sf_dir), SLICE_DIMS, T_STAR)


@query("weakest_slice", _with(
    "SELECT * FROM slice_rates ORDER BY recall, slice_order, slice_value NULLS FIRST LIMIT 1", SQL_SLICES))
def q_weakest_slice(spark, sf_dir):
    return M.weakest_slice(M.slice_metrics(scored(spark, sf_dir), SLICE_DIMS, T_STAR))


@query("stratified_split", _with("SELECT order_id, returned, rank_in_class, split FROM split", SQL_SPLIT))
def q_split(spark, sf_dir):
    return split_features(spark, sf_dir).select("order_id", "returned", "rank_in_class", "split")


@query("split_class_counts", _with(
    "SELECT split, returned, count(*) AS n FROM split GROUP BY split, returned", SQL_SPLIT))
def q_split_counts(spark, sf_dir):
    return split_features(spark, sf_dir).groupBy("split", "returned").agg(F.count(F.lit(1)).alias("n"))


SIZED_TEST_ROWS = 1000


@query("stratified_split_sized", _with(
    f"""SELECT order_id, returned, CASE WHEN rank_in_class <= quota THEN 'test' ELSE 'train' END AS split
    FROM split JOIN (
      SELECT returned, q + CAST(row_number() OVER (ORDER BY share - q DESC, returned)
                                <= {SIZED_TEST_ROWS} - sum(q) OVER () AS BIGINT) AS quota
      FROM (SELECT returned, {SIZED_TEST_ROWS}::DOUBLE * count(*) / sum(count(*)) OVER () AS share, floor(share) AS q
            FROM order_features GROUP BY returned)) USING (returned)""", SQL_SPLIT))
def q_split_sized(spark, sf_dir):
    """WIN6 with a fixed number of test rows."""
    return SM.stratified_split_sized(order_features(spark, sf_dir), "returned", "order_id", SIZED_TEST_ROWS,
                                     SPLIT_SEED).select("order_id", "returned", "split")


@query("category_parameters", _with(
    """SELECT order_id, product_category, base_price, round(price_inr / base_price, 6) AS price_ratio
    FROM order_features LEFT JOIN (SELECT p_type AS product_category, round(avg(p_retailprice), 4) AS base_price
                                   FROM part GROUP BY p_type) USING (product_category)""", SQL_FEATURES))
def q_category_parameters(spark, sf_dir):
    """JN8: each order's price against the base price of its category."""
    base = Tables(spark, sf_dir).part.groupBy(F.col("p_type").alias("product_category")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("base_price"))
    return order_features(spark, sf_dir).join(base, "product_category", "left").select(
        "order_id", "product_category", "base_price", F.round(F.col("price_inr") / F.col("base_price"), 6).alias("price_ratio"))


@query("stratified_folds", _with(
    f"""SELECT order_id, returned,
       CAST((row_number() OVER (PARTITION BY returned ORDER BY
             ('0x' || substr(md5('{FOLD_SEED}:' || CAST(order_id AS VARCHAR)), 1, 8))::BIGINT, order_id) - 1) % 5
            AS INTEGER) AS fold
    FROM split WHERE split = 'train'""", SQL_SPLIT))
def q_folds(spark, sf_dir):
    train = split_features(spark, sf_dir).where(F.col("split") == "train").select("order_id", "returned")
    return SM.stratified_folds(train, "returned", "order_id", 5, FOLD_SEED).select("order_id", "returned", "fold")


@query("majority_baseline", _with(
    """SELECT CAST(m.majority AS INTEGER) AS majority, count(*) AS n_test,
       round(avg(CAST(returned = m.majority AS DOUBLE)), 6) AS accuracy,
       round(coalesce(2.0 * count(*) FILTER (WHERE returned = 1 AND m.majority = 1)
         / nullif(2 * count(*) FILTER (WHERE returned = 1 AND m.majority = 1)
                  + count(*) FILTER (WHERE returned = 0 AND m.majority = 1)
                  + count(*) FILTER (WHERE returned = 1 AND m.majority = 0), 0), 0), 6) AS f1
    FROM split, (SELECT returned AS majority FROM split WHERE split = 'train'
                 GROUP BY returned ORDER BY count(*) DESC, returned LIMIT 1) m
    WHERE split = 'test' GROUP BY m.majority""", SQL_SPLIT))
def q_majority(spark, sf_dir):
    return ST.majority_baseline(split_features_table(spark, sf_dir), "returned")


@query("class_weights", _with(
    """SELECT returned, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
    FROM (SELECT returned, count(*) AS n FROM split WHERE split = 'train' GROUP BY returned)""", SQL_SPLIT))
def q_class_weights(spark, sf_dir):
    train = split_features(spark, sf_dir).where(F.col("split") == "train")
    return ST.class_weights(train, "returned").withColumn("weight", F.round("weight", 6))


@query("onehot_counts", _with(
    """SELECT column_name AS "column", value, n_train,
       CAST(row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INTEGER) AS idx
    FROM (SELECT 'product_category' AS column_name, product_category AS value, count(*) AS n_train
          FROM split WHERE split = 'train' AND product_category IS NOT NULL GROUP BY 2
          UNION ALL
          SELECT 'payment_method', payment_method, count(*)
          FROM split WHERE split = 'train' AND payment_method IS NOT NULL GROUP BY 2)""", SQL_SPLIT))
def q_onehot(spark, sf_dir):
    train = split_features(spark, sf_dir).where(F.col("split") == "train")
    return ST.vocabulary(train, FT.FEATURES_CATEGORICAL)


def _impute_sql() -> str:
    meds = ",\n".join(f"  (SELECT median({c}) FROM train) AS med_{c}" for c in FT.FEATURES_NUMERIC)
    rows = []
    for c in FT.FEATURES_NUMERIC:
        rows.append(
            f"SELECT '{c}' AS \"column\", 'numeric' AS kind, round(CAST(med_{c} AS DOUBLE), 6) AS median, "
            f"round(avg(coalesce(CAST({c} AS DOUBLE), med_{c})), 6) AS mean, "
            f"round(stddev_pop(coalesce(CAST({c} AS DOUBLE), med_{c})), 6) AS std, "
            f"CAST(NULL AS VARCHAR) AS mode FROM train, meds GROUP BY med_{c}")
    for c in FT.FEATURES_CATEGORICAL:
        rows.append(
            f"SELECT '{c}', 'categorical', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
            f"(SELECT CAST({c} AS VARCHAR) FROM train WHERE {c} IS NOT NULL GROUP BY 1 "
            f"ORDER BY count(*) DESC, 1 LIMIT 1)")
    return (",\ntrain AS (SELECT * FROM split WHERE split = 'train'),\nmeds AS (SELECT\n" + meds + ")",
            "\nUNION ALL\n".join(rows))


_IMP_CTE, _IMP_BODY = _impute_sql()
SQL_IMPUTE = SQL_SPLIT + _IMP_CTE


@query("impute_stats", _with(_IMP_BODY, SQL_IMPUTE))
def q_impute_stats(spark, sf_dir):
    train = split_features_table(spark, sf_dir).where(F.col("split") == "train")
    return ST.impute_stats(train, FT.FEATURES_NUMERIC, FT.FEATURES_CATEGORICAL)


def _scaled_sql() -> str:
    stats = ",\n".join(
        f"  (SELECT median({c}) FROM train) AS med_{c}" for c in FT.FEATURES_NUMERIC)
    moments = ",\n".join(
        f"  avg(coalesce(CAST({c} AS DOUBLE), med_{c})) AS mean_{c}, "
        f"stddev_pop(coalesce(CAST({c} AS DOUBLE), med_{c})) AS std_{c}" for c in FT.FEATURES_NUMERIC)
    cols = ",\n".join(
        f"  round((coalesce(CAST({c} AS DOUBLE), med_{c}) - mean_{c}) / "
        f"coalesce(nullif(std_{c}, 0), 1), 6) AS {c}" for c in FT.FEATURES_NUMERIC)
    cte = (",\ntrain AS (SELECT * FROM split WHERE split = 'train'),\nmeds AS (SELECT\n" + stats + "),\n"
           "mom AS (SELECT\n" + moments + "\nFROM train, meds)")
    body = "SELECT order_id, split,\n" + cols + "\nFROM split, meds, mom"
    return cte, body


_SC_CTE, _SC_BODY = _scaled_sql()


@query("imputed_scaled", _with(_SC_BODY, SQL_SPLIT + _SC_CTE))
def q_imputed_scaled(spark, sf_dir):
    sp = split_features_table(spark, sf_dir)
    train = sp.where(F.col("split") == "train")
    # fit: exact medians, then moments of the imputed columns (full precision)
    med = ST.exact_medians(train, FT.FEATURES_NUMERIC)
    imputed = {c: F.coalesce(ST.present(c), F.lit(med[c])) for c in FT.FEATURES_NUMERIC}
    mom = train.agg(*[F.avg(e).alias(f"mean_{c}") for c, e in imputed.items()],
                    *[F.stddev_pop(e).alias(f"std_{c}") for c, e in imputed.items()]).first()
    cols = []
    for c, e in imputed.items():
        std = mom[f"std_{c}"] or 1.0
        cols.append(F.round((e - F.lit(mom[f"mean_{c}"])) / F.lit(std), 6).alias(c))
    return sp.select("order_id", "split", *cols)


# An order request takes what the base tables give it: an order without lines has no line values, one without a
# known customer, part or supplier lacks what they would tell.
SQL_VALID_INPUT = SQL_FEATURES + """,
requests AS (
  SELECT o.o_orderkey AS order_id, f.* EXCLUDE (order_id, payment_method), o.o_orderpriority AS payment_method
  FROM orders o LEFT JOIN order_features f ON f.order_id = o.o_orderkey)"""


def _valid_requests(spark, sf_dir) -> DataFrame:
    """Order requests: every order with its features (null where the tables have none)."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("payment_method"))
    return o.join(order_features(spark, sf_dir).drop("payment_method", "returned"), "order_id", "left")


_REQUIRED = [c for c in FT.FEATURE_ORDER if c != "rating_given"]


@query("validated_orders", _with(
    "SELECT order_id, payment_method, price_inr, discount_pct FROM requests WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _REQUIRED), SQL_VALID_INPUT))
def q_validated(spark, sf_dir):
    good, _ = FT.split_valid(_valid_requests(spark, sf_dir))
    return good.select("order_id", "payment_method", "price_inr", "discount_pct")


@query("rejects", _with(
    "SELECT order_id, 'Missing required order features: ' || concat_ws(', ', "
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _REQUIRED) + ") AS error FROM requests WHERE "
    + " OR ".join(f"{c} IS NULL" for c in _REQUIRED), SQL_VALID_INPUT))
def q_rejects(spark, sf_dir):
    """VAL1 over all eleven fields (the rating may be null)."""
    _, bad = FT.split_valid(_valid_requests(spark, sf_dir))
    return bad.select("order_id", "error")
