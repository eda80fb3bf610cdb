"""Scalar scoring expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's for identical results) ----
# Scorecard of the synthetic order generator: intercept and coefficients of
# z = -2.2 + 1.9*prev_return_ratio + 0.55*fit_risk + 0.014*(discount-20)/10
#     + 0.9*cod + 0.10*(delivery_days-4.5)/2 + 0.30*price/45000
#     + 0.05*weekend - 0.15*tanh(tenure/500);  p = 1/(1+exp(-z))
SCORECARD = {
    "intercept": -2.2,
    "prev_return_ratio": 1.9,
    "fit_risk": 0.55,
    "discount": 0.014,
    "cod": 0.9,
    "delivery_days": 0.10,
    "price": 0.30,
    "weekend": 0.05,
    "tenure": -0.15,
}
PRICE_SCALE = 45000.0          # upper price of the most expensive category
FIT_RISK_CATEGORIES = ("Apparel", "Footwear")
COD_METHOD = "COD"
RISK_THRESHOLD = 0.47          # t* of the tuned forest, fixed in the router
MEDIUM_BAND = 0.15             # Medium = [t, t+0.15)
POLICY_SIMILARITY_FLOOR = 0.40
# Product classes of the image head, in class-id order.
CLASS_NAMES = ["T-shirt/top", "Trouser", "Pullover", "Dress", "Coat", "Sandal", "Shirt", "Sneaker",
               "Bag", "Ankle boot"]
# --------------------------------------------------------------------------


def prev_return_ratio(orders: Column, returns: Column) -> Column:
    """SCL5 guarded ratio: returns/max(orders,1) when orders > 0 else 0."""
    return F.when(orders > 0, returns / F.greatest(orders, F.lit(1))).otherwise(F.lit(0.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    """SCL2."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def scorecard_logit(fit_risk_categories=FIT_RISK_CATEGORIES, cod_method=COD_METHOD) -> Column:
    """SCL3: fixed-coefficient logit over the order feature columns."""
    c = SCORECARD
    ratio = prev_return_ratio(F.col("num_previous_orders"), F.col("num_previous_returns"))
    fit = F.col("product_category").isin(*fit_risk_categories).cast("double")
    cods = (cod_method,) if isinstance(cod_method, str) else tuple(cod_method)
    cod = F.col("payment_method").isin(*cods).cast("double")
    return (F.lit(c["intercept"])
            + F.lit(c["prev_return_ratio"]) * ratio
            + F.lit(c["fit_risk"]) * fit
            + F.lit(c["discount"]) * (F.col("discount_pct") - 20) / 10
            + F.lit(c["cod"]) * cod
            + F.lit(c["delivery_days"]) * (F.col("delivery_days") - 4.5) / 2
            + F.lit(c["price"]) * (F.col("price_inr") / PRICE_SCALE)
            + F.lit(c["weekend"]) * F.col("is_weekend_order")
            + F.lit(c["tenure"]) * F.tanh(F.col("customer_tenure_days") / 500))


def scorecard_sql(fit_risk_categories=FIT_RISK_CATEGORIES, cod_method=COD_METHOD) -> str:
    """:func:`scorecard_logit` as SQL text that Spark and DuckDB both read."""
    c = {k: f"CAST({v} AS DOUBLE)" for k, v in SCORECARD.items()}
    names = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    cods = (cod_method,) if isinstance(cod_method, str) else tuple(cod_method)
    return f"""({c["intercept"]}
     + {c["prev_return_ratio"]} * CASE WHEN num_previous_orders > 0
            THEN CAST(num_previous_returns AS DOUBLE) / greatest(num_previous_orders, 1) ELSE CAST(0 AS DOUBLE) END
     + {c["fit_risk"]} * CAST(product_category IN ({names(fit_risk_categories)}) AS DOUBLE)
     + {c["discount"]} * (discount_pct - 20) / 10
     + {c["cod"]} * CAST(payment_method IN ({names(cods)}) AS DOUBLE)
     + {c["delivery_days"]} * (delivery_days - CAST(4.5 AS DOUBLE)) / 2
     + {c["price"]} * (price_inr / CAST({PRICE_SCALE} AS DOUBLE))
     + {c["weekend"]} * is_weekend_order
     + {c["tenure"]} * tanh(customer_tenure_days / CAST(500 AS DOUBLE)))"""


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def risk_bucket(p: Column, t: float = RISK_THRESHOLD, band: float = MEDIUM_BAND) -> Column:
    """SCL6: on the unrounded probability; null for a null or NaN probability."""
    return (F.when(p < F.lit(t), "Low")
            .when(p < F.lit(t) + F.lit(band), "Medium")
            .when(p.isNotNull() & ~F.isnan(p), "High"))


def cut_points(t: float = RISK_THRESHOLD, band: float = MEDIUM_BAND) -> Column:
    """SCL7: bucket cut-point text, 4 decimals."""
    lo = f"{t:.4f}"
    hi = f"{t + band:.4f}"
    return F.struct(
        F.lit(f"probability < {lo}").alias("low"),
        F.lit(f"{lo} <= probability < {hi}").alias("medium"),
        F.lit(f"probability >= {hi}").alias("high"),
    )


def predicted(p: Column, t: float) -> Column:
    """FLT3: ``p >= t`` as 0/1."""
    return (p >= F.lit(t)).cast("int")


def safe_div(a: Column, b: Column) -> Column:
    """Zero denominator gives 0 (the metric convention)."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
