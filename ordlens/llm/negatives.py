"""Hard-negative mining with scores from a residue-number-system GEMM.

Integer vectors are reduced modulo several small primes (centred residues).
For each prime one float32 matrix product of an anchor block and a row block
is exact, since no sum can reach 2^24; its residue is the score's. Mixed-radix
Chinese remaindering gives the exact signed score from the residues. The
number of primes follows from the largest score that the data allow.

Two rounds over (anchor block, row block) pairs: rows of the anchor's label
give its positives, then rows of other labels give, for each positive, the
best negatives inside its score band. A block returns a few rows per anchor;
windows take the final ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordlens.llm.topk import _sane
from ordlens.session import materialize

#: Rows per block on either side, anchors scored at a time, and components multiplied at a time.
ROW_BLOCK, ANCHOR_BLOCK, STRIP, DEPTH = 8192, 8192, 256, 256
#: Vectors with a squared norm from here on take no part: their scores need not fit a long.
MAX_SQUARE = 2.0**62


def primes_for(depth: int, bound: int) -> list[int]:
    """The largest primes whose centred residues sum exactly in float32 over ``depth`` terms, enough for +-``bound``."""
    p, found, product = 2 * math.isqrt((1 << 24) // max(depth, 1)), [], 1
    while product <= 2 * bound + 1:
        p -= 1
        if p < 2:
            raise ValueError("scores are too large for the primes of this depth")
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            found.append(p)
            product *= p
    return found


def centred(a: np.ndarray, p: int) -> np.ndarray:
    """Residues of ``a`` modulo ``p`` between -p/2 and p/2."""
    r = np.mod(a, p)
    return np.where(r > p // 2, r - p, r)


class Residues:
    """A matrix of integers as one float32 matrix per prime."""

    def __init__(self, x: np.ndarray, primes: list[int]):
        self.primes = primes
        self.parts = [centred(x, p).astype(np.float32) for p in primes]


def residue_product(a: Residues, at: slice | np.ndarray, b: Residues, to: np.ndarray) -> np.ndarray:
    """Exact ``a[at] @ b[to].T`` as 64-bit integers: float32 products modulo each prime, then Chinese remaindering."""
    residues = []
    for p, x, y in zip(a.primes, a.parts, b.parts):
        x, y = x[at], y[to]
        r = np.zeros((len(x), len(y)), np.int64)
        for d in range(0, x.shape[1], DEPTH):  # every float32 sum stays below 2^24
            r += (x[:, d : d + DEPTH] @ y[:, d : d + DEPTH].T).astype(np.int64)
        residues.append(np.mod(r, p))
    return remaindered(residues, a.primes)


def remaindered(residues: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers of least size with these residues (mixed-radix digits, centred from the top one down)."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        v, radix = residues[i], 1
        for d, q in zip(digits, primes):
            v = v - d * radix
            radix = radix * q % p
        digits.append(np.mod(v, p) if i == 0 else np.mod(np.mod(v, p) * pow(radix, -1, p), p))
    # digits between -p/2 and p/2 name every integer within half the product once; the score fits 64 bits, so a
    # wrap-around on the way to it is harmless
    out, radix, carry = np.zeros_like(digits[0]), 1, np.zeros_like(digits[0])
    for d, p in zip(digits, primes):
        d = d + carry
        high = d > p // 2
        carry = high.astype(np.int64)
        with np.errstate(over="ignore"):
            out = out + (d - p * carry) * np.int64(((radix + 2**63) % 2**64) - 2**63)
        radix *= p
    return out


def _ints(t: pa.Table, column: str) -> np.ndarray:
    return t.column(column).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's ``k`` best allowed scores, ties to the smaller id."""
    s = np.where(allowed, scores, np.iinfo(np.int64).min)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        allowed = allowed & (s >= kth[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((ids[col], -s[row, col], row))
    row, col = row[order], col[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1)) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate((first, [len(row)]))))
    return row[place < k], col[place < k]


def _strips(anchors: pa.Table, rows: pa.Table, same: bool, primes: list[int]):
    """(anchor numbers, row numbers, scores) of all pairs of a block pair whose labels agree (or differ), in strips."""
    a_label, r_label = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
    a, r = Residues(_ints(anchors, "v"), primes), Residues(_ints(rows, "v"), primes)
    for label in np.unique(a_label):
        mine = np.flatnonzero(a_label == label)
        theirs = np.flatnonzero((r_label == label) == same)
        if len(theirs):
            for at in range(0, len(mine), STRIP):
                some = mine[at : at + STRIP]
                yield some, theirs, residue_product(a, some, r, theirs)


def _positives(primes: list[int], k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros((0, 3), np.int64)]
        if anchors.num_rows and rows.num_rows:
            a_row, a_id, r_id = (t.column(c).to_numpy() for t, c in ((anchors, "row"), (anchors, "id"), (rows, "id")))
            for some, theirs, s in _strips(anchors, rows, True, primes):
                i, j = _best(s, r_id[theirs], a_id[some][:, None] != r_id[theirs][None, :], k)
                out.append(np.column_stack((a_row[some][i], r_id[theirs][j], s[i, j])))
        return pa.table(dict(zip(("row", "positive_id", "score"), np.concatenate(out).T.copy())))

    return run


def _negatives(primes: list[int], k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros((0, 5), np.int64)]
        if anchors.num_rows and rows.num_rows:
            a_row, r_id = anchors.column("row").to_numpy(), rows.column("id").to_numpy()
            positives = anchors.column("positives").to_pylist()
            most = max(map(len, positives))
            for some, theirs, s in _strips(anchors, rows, False, primes):
                for n in range(most):  # the n-th positive of every anchor that has one
                    has = np.array([i for i, a in enumerate(some) if n < len(positives[a])], np.int64)
                    if not len(has):
                        continue
                    p = [positives[a][n] for a in some[has]]
                    # floor and ceiling of the band in exact integers, so that products cannot leave 64 bits
                    top = np.array([x["score"] for x in p], np.int64)[:, None]
                    least = np.array([-(-low * x["score"] // high) for x in p], np.int64)[:, None]
                    band = s[has]
                    i, j = _best(band, r_id[theirs], (band <= top) & (band >= least), k)
                    pid = np.array([x["positive_id"] for x in p], np.int64)
                    out.append(np.column_stack((a_row[some[has]][i], np.full(len(i), n), pid[i], r_id[theirs][j], band[i, j])))
        return pa.table(dict(zip(("row", "n", "positive_id", "negative_id", "score"), np.concatenate(out).T.copy())))

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: (vec_id, embedding, label); components become ``floor(scale *
    x)``, scores are integer inner products. An anchor's positives are its
    best rows of the same label with another vec_id; for each of them the best
    rows of other labels with low * positive <= high * negative <= high *
    positive are returned, ranked from 1. Ties go to the smaller vec_id.

    Rows with a null id, label or vector, or a null or non-finite component
    take no part, nor do vectors whose squared norm reaches 2^62 (their scores
    need not fit a long); vectors meet those of their own length only. Each of
    several rows of one id counts, but an anchor never meets its own id. Other
    columns are ignored; an empty table gives an empty result.

    Both sides are dealt into blocks of bounded size by row number, whatever
    the labels are; each block is copied once per block of the other side.
    """
    v = F.col("embedding")
    whole = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + whole(x).cast("double") * whole(x).cast("double"))
    fits = F.forall(v, lambda x: F.abs(x.cast("double")) < F.lit(2.0**31 / scale)) & (square < MAX_SQUARE)
    ints = materialize(rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _sane(v)).where(fits).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"), F.transform(v, lambda x: whole(x).cast("int")).alias("v"),
        F.size(v).alias("dim"), square.alias("square"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "negative-vectors")
    n, na, largest, most = ints.agg(F.count("*"), F.count_if("anchor"), F.max("square"), F.max(F.when(F.col("anchor"), F.col(
        "square")))).first()
    depth = min(ints.agg(F.max("dim")).first()[0] or 1, DEPTH) or 1
    # |score| <= |a| |b|, with room for the rounding of the norms
    primes = primes_for(depth, math.isqrt(int((largest or 0) * 1.001) + 1) * math.isqrt(int((most or 0) * 1.001) + 1) + 2**10)
    rb, ab = -(-n // ROW_BLOCK) or 1, -(-na // ANCHOR_BLOCK) or 1
    h = F.xxhash64("row")
    corpus = ints.select("dim", F.explode(F.sequence(F.lit(0), F.lit(ab - 1))).alias("ab"),
                         F.pmod(h, F.lit(rb)).cast("int").alias("rb"), "id", "label", "v")

    def dealt(anchors: DataFrame) -> DataFrame:
        return anchors.withColumn("ab", F.pmod(h, F.lit(ab)).cast("int")).withColumn(
            "rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))))

    key = ["dim", "ab", "rb"]
    anchors = ints.where("anchor").select("row", "id", "label", "v", "dim")
    near = dealt(anchors).groupBy(*key).cogroup(corpus.groupBy(*key)).applyInArrow(
        _positives(primes, positives), "row long, positive_id long, score long")
    first = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id")
    near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
    chosen = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "positive_id", "score"))).alias("positives"))
    paired = materialize(anchors.join(chosen, "row"), "negative-anchors")
    far = dealt(paired).groupBy(*key).cogroup(corpus.groupBy(*key)).applyInArrow(
        _negatives(primes, negatives, low, high), "row long, n long, positive_id long, negative_id long, score long")
    best = Window.partitionBy("row", "n").orderBy(F.desc("score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    own = paired.select("row", F.col("id").alias("anchor_id"), "positives")
    return far.join(own, "row").select(
        "anchor_id", "positive_id", "rank", "negative_id",
        F.element_at("positives", (F.col("n") + 1).cast("int"))["score"].alias("positive_score"),
        F.col("score").alias("negative_score"))
