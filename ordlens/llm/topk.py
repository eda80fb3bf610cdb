"""Exact top-k search by inner product with a pivot table.

Every vector carries its distances to many pivots, chosen farthest-first. By
the triangle inequality ``|d(q,p) - d(x,p)|`` bounds ``d(q,x)`` from below for
each pivot; the largest bound gives an upper bound on the inner product
``(|q|^2 + |x|^2 - d^2) / 2``. Candidates are scored in the order of that
bound, until it falls below the k-th best score found: the rest cannot enter.

The first pivots are also the centres of cells: a row lies in its nearest
one's, large cells are split. Every query first meets its own cell; the k-th
best score there is the floor with which it meets the other blocks, and a
block whose ranges of pivot distances cannot reach it is skipped as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordlens.session import materialize

PIVOTS = 64
#: Rows of each vector length among which pivots are chosen.
SAMPLE = 4096
#: Vector lengths that get pivots (the others are searched without, still exactly).
LENGTHS = 64
CORPUS_BLOCK = 8192
QUERY_BLOCK = 1024
#: Candidates scored at a time, and pivots that a bound takes at a time.
STEP, GROUP = 256, 64


def _sane(v: Column) -> Column:
    inf = float("inf")
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), np.int64).reshape(len(column), -1)


def _distances(pivots: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, p = x.astype(np.float64), pivots.astype(np.float64)
    d2 = (a * a).sum(1)[:, None] + (p * p).sum(1) - 2 * (a @ p.T)
    return np.sqrt(np.maximum(d2, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can reach 2^53, else in 64-bit integers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1) < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows, each the one farthest from those before it."""
    chosen = [int(np.argmax((x.astype(np.float64) ** 2).sum(1)))]
    nearest = _distances(x[chosen], x)[:, 0]
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, _distances(x[chosen[-1:]], x)[:, 0])
    return x[chosen]


def _search(k: int):
    def search(key, queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 5), np.int64)]
        if len(queries) and len(corpus):
            q, x = _matrix(queries.v), _matrix(corpus.v)
            dq, dx = (np.array(t.d.to_list(), np.float32).reshape(len(t), -1) for t in (queries, corpus))
            ids = corpus.id.to_numpy()
            qq, xx = (q.astype(float) ** 2).sum(1), (x.astype(float) ** 2).sum(1)
            low, high, longest = dx.min(0), dx.max(0), xx.max()

            def ceiling(i: int, gap: np.ndarray, length) -> np.ndarray:
                """Upper bound of the score; the room covers float32 distances and all rounding."""
                room = 1 + 1e-5 * (qq[i] + length)
                return (qq[i] + length - np.maximum(gap, 0) ** 2) / 2 + room

            for i, (qid, floor) in enumerate(zip(queries.id, queries.floor)):
                least = -np.inf if pd.isna(floor) else float(floor)
                gap = np.maximum(dq[i] - high, low - dq[i]).max(initial=0)
                if ceiling(i, gap, longest) < least:
                    continue  # the whole block is out of reach
                left = np.flatnonzero(ids != qid)
                gap = np.zeros(len(left), np.float32)
                for at in range(0, dx.shape[1], GROUP):
                    gap = np.maximum(gap, np.abs(dx[left, at : at + GROUP] - dq[i, at : at + GROUP]).max(1))
                    keep = ceiling(i, gap.astype(float), xx[left]) >= least
                    left, gap = left[keep], gap[keep]
                bound = ceiling(i, gap.astype(float), xx[left])
                order = np.argsort(-bound)
                best, scored = np.zeros((0, 2), np.int64), 0
                for at in range(0, len(order), STEP):
                    some = order[at : at + STEP]
                    if bound[some[0]] < least or len(best) == k and bound[some[0]] < -best[-1, 0]:
                        break
                    scored += len(some)
                    best = np.concatenate((best, np.stack((-_scores(q[i], x[left[some]]), ids[left[some]]), 1)))
                    best = best[np.lexsort((best[:, 1], best[:, 0]))[:k]]
                if len(best):
                    out.append(np.column_stack((np.full(len(best), queries.row.iloc[i]), np.full(len(best), qid), best[:, 1],
                                                -best[:, 0], np.full(len(best), scored))))
        rows = np.concatenate(out)
        return pd.DataFrame(dict(zip(("qrow", "query_id", "vec_id", "score", "scored"), rows.T)))

    return search


HITS = "qrow long, query_id long, vec_id long, score long, scored long"


def pivot_table(vectors: DataFrame, is_query: Column, scale: int) -> DataFrame:
    """row, id, v, dim, query, d (distances to the pivots), cell: every vector that takes part."""
    v = F.col("embedding")
    ints = materialize(vectors.where(F.col("vec_id").isNotNull() & _sane(v)).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"),
        F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("query")), "topk-vectors")
    sizes = {r[0]: r[1] for r in ints.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()}
    pivots: dict[int, np.ndarray] = {}
    cells: dict[int, int] = {}
    for dim, n in sizes.items():
        if dim:
            sample = ints.where(F.col("dim") == dim).orderBy(F.xxhash64("id", "row")).limit(SAMPLE).select("v").toPandas()
            pivots[dim] = farthest_first(_matrix(sample.v), PIVOTS)
            cells[dim] = min(len(pivots[dim]), -(-n // CORPUS_BLOCK))

    def distances(it):
        for pdf in it:
            d, cell = [[] for _ in range(len(pdf))], np.zeros(len(pdf), np.int64)
            for dim in pdf.dim.unique():
                if dim in pivots:
                    at = np.flatnonzero((pdf.dim == dim).to_numpy())
                    far = _distances(pivots[dim], _matrix(pdf.v.iloc[at])).astype(np.float32)
                    cell[at] = far[:, : cells[dim]].argmin(1)
                    for i, row in zip(at, far):
                        d[i] = row
            yield pdf.assign(d=d, cell=cell)

    return materialize(ints.mapInPandas(
        distances, "row long, id long, v array<long>, dim int, query boolean, d array<float>, cell long"), "topk-pivots")


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """qrow, query_id, vec_id, score, scored: each block's best for each query row, and how many it scored for it."""
    table = pivot_table(vectors, is_query, scale)
    nq = table.where("query").count()
    qb = -(-nq // QUERY_BLOCK) or 1
    h = F.xxhash64("row")
    sizes = table.groupBy("dim", "cell").count().select(
        "dim", "cell", F.ceil(F.col("count") / F.lit(float(CORPUS_BLOCK))).cast("int").alias("parts"))  # one row per cell
    corpus = table.join(sizes, ["dim", "cell"]).select(
        "dim", "cell", F.pmod(h, F.col("parts")).cast("int").alias("part"), "id", "v", "d",
        F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    blocks = sizes.select("dim", F.col("cell").alias("to"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = [F.col(c).alias(c) for c in ("row", "dim", "cell", "id", "v", "d")]  # columns apart from the corpus side's
    queries = table.where("query").select(*own, F.pmod(h, F.lit(qb)).cast("int").alias("qb"))
    dealt = queries.join(blocks, "dim")
    key = ["dim", "cell", "part", "qb"]

    def meet(some: DataFrame) -> DataFrame:
        return some.drop("cell").withColumnRenamed("to", "cell").groupBy(*key).cogroup(corpus.groupBy(*key)).applyInPandas(
            _search(k), HITS)

    none = F.lit(None).cast("double")
    home = materialize(meet(dealt.where("to = cell and part = 0").withColumn("floor", none)), "topk-home")
    order = Window.partitionBy("qrow").orderBy(F.desc("score"))
    floors = home.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(
        F.col("qrow").alias("row"), F.col("score").cast("double").alias("floor"))
    return home.unionByName(meet(dealt.where("to <> cell or part > 0").join(floors, "row", "left")))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each query row.

    ``vectors``: (vec_id, embedding); components become ``floor(scale * x)``.
    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id, and a query with fewer candidates gets them all. Rows with a null
    id, a null vector or a null or non-finite component take no part; every
    one of repeated rows is a candidate, and a query if its id is one; rows of
    a query's own vec_id are no candidates of it; vectors are compared with
    those of their own length only. Other columns are ignored; an empty table
    gives an empty result.

    Corpus blocks and query blocks are of bounded size; each pair is one group
    and returns at most k rows per query.
    """
    hits = search(vectors, is_query, k, scale)
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
