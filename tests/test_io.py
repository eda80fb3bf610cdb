"""Sources and sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from ordlens.sources import sinks as SK
from ordlens.sources import tables as TB


def test_orders_csv_blank_is_null(spark):
    d = tempfile.mkdtemp(prefix="ordlens-io-")
    path = os.path.join(d, "orders.csv")
    with open(path, "w") as f:
        f.write("order_id,product_category,price_inr,discount_pct,payment_method,customer_tenure_days,"
                "num_previous_orders,num_previous_returns,delivery_distance_km,delivery_days,"
                "is_weekend_order,rating_given,returned\n")
        f.write("1,Apparel,999.0,10.5,COD,100,2,1,12.5,3,0,,1\n")
        f.write("2,Home,450.0,0.0,Wallet,5,0,0,300.0,7,1,4.0,0\n")
    df = TB.read_orders_csv(spark, path)
    rows = {r.order_id: r for r in df.collect()}
    assert rows[1].rating_given is None and rows[2].rating_given == 4.0
    assert dict(df.dtypes)["customer_tenure_days"] == "int"


def test_json_array_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="ordlens-io-")
    path = os.path.join(d, "policies.json")
    with open(path, "w") as f:
        json.dump([{"document_id": "P1", "title": "T", "text": "A. B"},
                   {"document_id": "P2", "title": "U", "text": "C"}], f)
    df = TB.read_json_array(spark, path, TB.POLICY_SCHEMA)
    assert df.count() == 2
    SK.write_json_lines(df, os.path.join(d, "out_json"))
    assert spark.read.json(os.path.join(d, "out_json")).count() == 2
    cfg = SK.write_config(spark, os.path.join(d, "cfg"), threshold=0.47, model_version="v1")
    assert cfg.first().threshold == 0.47


def test_matrix_csv_pivot(spark):
    d = tempfile.mkdtemp(prefix="ordlens-io-")
    long_df = spark.createDataFrame([(0, 0, 5), (0, 1, 2), (1, 1, 7)], "t int, p int, n long")
    SK.write_matrix_csv(long_df, "t", "p", "n", [0, 1], os.path.join(d, "cm"))
    back = spark.read.option("header", True).csv(os.path.join(d, "cm")).orderBy("t").collect()
    assert [(int(r["0"]), int(r["1"])) for r in back] == [(5, 2), (0, 7)]


def test_cached_table_builds_once(spark):
    d = tempfile.mkdtemp(prefix="ordlens-io-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3).select(F.col("id"))

    a = SK.cached_table(spark, os.path.join(d, "t"), build, "s1")
    b = SK.cached_table(spark, os.path.join(d, "t"), build, "s1")
    assert a.count() == b.count() == 3 and len(calls) == 1
    SK.cached_table(spark, os.path.join(d, "t"), build, "s2")
    SK.cached_table(spark, os.path.join(d, "t"), build, "s1", "2")
    assert len(calls) == 3
