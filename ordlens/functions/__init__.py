
"""Column-expression helpers."""

from pyspark.sql import DataFrame


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null (a null group is data).

    Right-side key columns are renamed and dropped, so the result keeps one
    copy of each key, like ``join(on=[...])``.
    """
    keys = list(keys)
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])
