"""Every query with a SQL oracle equals DuckDB on the sf0.001 tables."""

import os
import sys

import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import digest  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from ordlens.plans import catalog  # noqa: E402

ORACLE = catalog.ORACLE
SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    assert sorted(df.columns) == sorted(o_cols)
    o_types = {c: str(t) for c, t in zip(o_cols, duck.sql(ORACLE[name]).types)}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == o_types
    assert len(s_rows) == len(o_rows)
    assert digest(s_rows, df.columns)[0] == digest(o_rows, o_cols)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert {"slice_type", "slice_value", "n", "recall", "precision"} <= set(df.columns)


def test_every_query_is_registered_with_a_callable():
    qs = E.queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 50
