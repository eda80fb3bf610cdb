"""Best-fit packing of documents into sequences by vector best-fit.

A piece needs three things of a sequence: tokens, a document slot, and
attention cost (its length squared). All three follow from its length, so the
histogram of piece lengths (at most ``tokens`` rows at any corpus size) holds
all that packing must know. Vector best-fit runs over that histogram, longest
pieces first: sequences of equal residual capacities form one group, and a
piece goes to the group of the best score among those with room in every
dimension, else to a new sequence. The resulting plan (length and rank range
-> sequence range, offset) is joined back to the ranked pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordlens.llm.minhash import batches
from ordlens.llm.tokens import encoder, release_memory
from ordlens.session import materialize

#: Pieces of one length are ranked in cells of about this many rows.
CELL = 20_000
#: Plans of more rows than this are joined without a broadcast.
MAX_BROADCAST_RUNS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and how its residual is weighed."""

    tokens: int = 4096
    documents: int = 4096
    cost: int = 4096 * 4096
    #: 'norm': least weighted squared residual after placing; 'dot': largest weighted product of need and residual.
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)


def plan(histogram: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, sequence_from, offset): pieces of a length, by rank, in a row of sequences.

    Sequences with the same residuals are kept as one group of id ranges, so
    the work follows the number of lengths, not of pieces.
    """
    full = np.array([cap.tokens, cap.documents, cap.cost], np.float64)
    weights = np.array(cap.weights)
    residual = np.zeros((64, 3))  # of each group; -1 where no sequence is left in it
    residual[:] = -1
    groups: list[deque] = []
    where: dict[tuple, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def add(state: tuple, ranges: list[tuple[int, int]]) -> None:
        nonlocal residual, groups, where
        if state not in where:
            if len(groups) == len(residual):
                keep = [i for i, g in enumerate(groups) if g]
                states = residual[keep]
                residual = np.full((max(64, 2 * len(keep)), 3), -1.0)
                residual[: len(keep)] = states
                groups = [groups[i] for i in keep]
                where = {tuple(s): i for i, s in enumerate(states.tolist())}
            where[state] = len(groups)
            groups.append(deque())
        residual[where[state]] = state
        groups[where[state]].extend(ranges)

    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], np.float64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacity")
        left, rank = histogram[length], 0
        while left:
            r = residual[: len(groups)]
            fits = np.flatnonzero((r >= need).all(1))
            if len(fits):
                r = r[fits]
                if cap.rule == "dot":
                    score = -((r / full) * (need / full) * weights).sum(1)
                else:
                    score = ((((r - need) / full) ** 2) * weights).sum(1)
                g = int(fits[np.argmin(score)])
                state = tuple((residual[g] - need).tolist())
                offset, moved, group = int(cap.tokens - residual[g, 0]), [], groups[g]
                while left and group:
                    a, b = group.popleft()
                    n = min(b - a, left)
                    if a + n < b:
                        group.appendleft((a + n, b))
                    runs.append((length, rank, rank + n, a, offset))
                    moved.append((a, a + n))
                    rank, left = rank + n, left - n
                if not group:
                    residual[g] = -1
                add(state, moved)
                continue
            per = int(min(cap.tokens // length, cap.documents, cap.cost // (length * length)))
            for many, each in ((left // per, per), (1, left % per)):
                if many and each:
                    for j in range(each):
                        runs.append((length, rank, rank + many, sequences, j * length))
                        rank += many
                    add(tuple((full - each * need).tolist()), [(sequences, sequences + many)])
                    sequences += many
            left = 0
    return runs


def _cut(path: str, tokens: int, end_id: int):
    def run(it):
        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for rb in batches(it, "text", 4 << 20):
            ids, bounds = enc.encode(rb.column("text"))
            raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
            rows = []
            for doc, a, b in zip(rb.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                n = b - a + 1
                if n <= tokens:  # whole, as nearly all are
                    rows.append((doc, 0, 0, n, zlib.crc32(end, zlib.crc32(raw[4 * a : 4 * b]))))
                    continue
                for piece, start in enumerate(range(0, n, tokens)):
                    to = min(start + tokens, n)
                    crc = zlib.crc32(raw[4 * (a + start) : 4 * (a + min(to, n - 1))])
                    rows.append((doc, piece, start, to - start, zlib.crc32(end, crc) if to == n else crc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
        release_memory()

    return run


def pieces(docs: DataFrame, path: str, tokens: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of every document's ids (those of the tokenizer file, then ``end_id``): at most ``tokens`` each."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(path, tokens, end_id), PIECES)


def pack(docs: DataFrame, path: str, cap: Capacity = Capacity(), end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    All capacities are honoured; with the default ones document slots and
    attention cost follow from the token limit and never bind, so tokens decide.
    Only documents longer than a sequence are cut. Null and empty texts are
    the one end id. Null ids and repeated rows are packed like any other row,
    other columns are ignored, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, cap.tokens, end_id).withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most cap.tokens rows
    runs = plan(histogram, cap)
    sizes = spark.createDataFrame([(n, -(-c // CELL)) for n, c in histogram.items()], "length long, cells long")
    celled = cut.join(F.broadcast(sizes), "length").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells")))
    before = celled.groupBy("length", "cell").count().withColumn("base", F.sum("count").over(
        Window.partitionBy("length").orderBy("cell")) - F.col("count")).select("length", "cell", "base")
    own = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1
    ranked = celled.withColumn("own", own).join(before, ["length", "cell"]).withColumn("rank", F.col("base") + F.col("own"))
    table = spark.createDataFrame(runs, "length long, rank_from long, rank_to long, sequence_from long, at long")
    if len(runs) <= MAX_BROADCAST_RUNS:
        table = F.broadcast(table)
    r = ranked.alias("r").join(table.alias("t"), (F.col("r.length") == F.col("t.length")) & (
        F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return r.select("doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32",
                    (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
                    F.col("at").alias("offset"))
