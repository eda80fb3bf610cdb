"""Conversation structure repair with Four-Russians block tables.

A conversation's cheapest edit script is an edit distance to the language of
legal role sequences. Its cost-to-go after each row is a vector over the
language's states; vectors that differ by a constant act alike, so only a few
normalised ones exist. For every block of ``BLOCK`` row symbols the move from
each normalised vector to the next is computed once (``tables``). Rows are
processed block by block from the end by lookup; then each block is expanded
backward into its rows' vectors, and the script is read forward, taking the
ASCII-least edit that stays cheapest.

Conversations of any length are spread over tasks: rows are sorted by range
partitioning and cut into segments. A segment acts on vectors and states as a
finite map; maps compose, so a long conversation is a small scan over its
segments' maps, and each segment is then traced on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordlens.session import materialize

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: Symbols of a table's block, and rows of a segment.
BLOCK, SEGMENT = 4, 4096
#: Row symbols: role class (system, user, assistant, other) + 4 if truncated; 8: no row to decide (deleted, padding).
NONE = 8
#: States: nothing yet; system; a user turn awaits its answer; an answered pair. NEXT: state after a user or assistant turn.
START, SYSTEM, ASKED, DONE = range(4)
NEXT = (ASKED, ASKED, DONE, ASKED)
#: Lines that ``n`` inserted turns in a row give from a state.
TURNS = {START: ("user:", "assistant:"), SYSTEM: ("user:", "assistant:"), ASKED: ("assistant:", "user:"), DONE: ("user:", "assistant:")}
CLOSING = {START: 0, SYSTEM: 2, ASKED: 1, DONE: 0}


def _closed(v: list[int]) -> list[int]:
    """Costs-to-go when turns may also be inserted first (two in a row at most pay off)."""
    once = [min(c, INSERT + v[NEXT[s]]) for s, c in enumerate(v)]
    return [min(c, INSERT + once[NEXT[s]]) for s, c in enumerate(v)]


def _keep(symbol: int, state: int) -> tuple[int, int] | None:
    """(cost, next state) of keeping a row as it is, if its role may come next."""
    role, cost = symbol % 4, KEEP + BROKEN * (symbol >= 4)
    if role == 0 and state == START:
        return cost, SYSTEM
    if role == 1 and state != ASKED or role == 2 and state == ASKED:
        return cost, NEXT[state]
    return None


def _step(symbol: int, after: list[int]) -> list[int]:
    """Costs-to-go before a row from those after it."""
    out = []
    for s in range(4):
        best = min(DELETE + after[s], REROLE + BROKEN * (symbol >= 4) + after[NEXT[s]])
        k = _keep(symbol, s)
        out.append(min(best, k[0] + after[k[1]]) if k else best)
    return _closed(out)


def _edit(symbol: int, state: int, after: list[int]) -> tuple[int, str, int]:
    """(turns inserted first, D, K or R, next state): the ASCII-least of the cheapest edits at a row."""
    inserted = 0
    while True:
        here = _step(symbol, after)[state]
        if here == DELETE + after[state]:
            return inserted, "D", state
        if here == INSERT + _step(symbol, after)[NEXT[state]]:
            inserted, state = inserted + 1, NEXT[state]
            continue
        k = _keep(symbol, state)
        if k and here == k[0] + after[k[1]]:
            return inserted, "K", k[1]
        return inserted, "R", NEXT[state]


class Tables:
    """Normalised cost vectors, and the moves between them by symbol and by block of symbols.

    ``end``: vector at a conversation's end. ``move[s, v]``: vector before a
    row of symbol s from the one after it; ``block[b, v]``: the same over a
    block (its symbols as digits of base 9, the first one highest). ``inserts``,
    ``op``, ``to`` [symbol, vector after, state]: the edit taken at a row.
    """

    def __init__(self):
        vectors = [tuple(INSERT * CLOSING[s] for s in range(4))]
        self.end, number = 0, {vectors[0]: 0}
        at = 0
        move: list[list[int]] = []
        while at < len(vectors):
            row = []
            for symbol in range(NONE):
                v = _step(symbol, list(vectors[at]))
                low = min(v)
                v = tuple(x - low for x in v)
                if v not in number:
                    number[v] = len(vectors)
                    vectors.append(v)
                row.append(number[v])
            move.append([*row, at])
            at += 1
        self.vectors = vectors
        self.move = np.array(move, np.int16).T.copy()
        n, symbols = len(vectors), NONE + 1
        block = np.arange(n, dtype=np.int16)[None, :]
        for _ in range(BLOCK):  # one more symbol in front of every block
            block = self.move[:, block].reshape(-1, n)
        self.block = block
        edits = [[[_edit(s, state, list(v)) for state in range(4)] for v in vectors] for s in range(NONE)]
        self.inserts, self.op, self.to = (np.zeros((symbols, n, 4), np.int16) for _ in range(3))
        self.to[NONE] = np.arange(4)
        for s in range(NONE):
            for v in range(n):
                for state in range(4):
                    i, op, to = edits[s][v][state]
                    self.inserts[s, v, state], self.op[s, v, state], self.to[s, v, state] = i, "DKR".index(op), to


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def codes(symbols: np.ndarray) -> np.ndarray:
    """Block codes of rows of symbols (a matrix whose width is a multiple of ``BLOCK``)."""
    digits = symbols.reshape(len(symbols), -1, BLOCK).astype(np.int64)
    return digits @ ((NONE + 1) ** np.arange(BLOCK - 1, -1, -1))


def padded(rows: list[np.ndarray]) -> np.ndarray:
    """Symbol lists as one matrix, filled on the left."""
    width = -(-max(map(len, rows), default=0) // BLOCK) * BLOCK
    out = np.full((len(rows), width), NONE, np.int8)
    for i, r in enumerate(rows):
        out[i, width - len(r) :] = r
    return out


def row_vectors(symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector after every row, and that before the first: block boundaries by table lookup, then each block expanded."""
    t = tables()
    code = codes(symbols)
    after = np.zeros(symbols.shape, np.int16)
    v = np.asarray(end, np.int16)
    for b in range(code.shape[1] - 1, -1, -1):
        after[:, b * BLOCK + BLOCK - 1] = v
        v = t.block[code[:, b], v]
    for j in range(BLOCK - 1, 0, -1):  # inside the blocks, all of them at once
        after[:, j - 1 :: BLOCK] = t.move[symbols[:, j::BLOCK], after[:, j::BLOCK]]
    return after, v


def segment_map(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector before, by vector after; state after, by vector after and state before) of one segment."""
    t = tables()
    n = len(t.vectors)
    rows = padded([symbols])
    after, before = row_vectors(np.repeat(rows, n, 0), np.arange(n))
    state = np.tile(np.arange(4, dtype=np.int16), (n, 1))
    for j in range(rows.shape[1]):
        state = t.to[rows[0, j], after[:, j][:, None], state]
    return before, state


def _compose(maps: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The map of consecutive segments."""
    before, state = maps[-1]
    for b, s in reversed(maps[:-1]):
        state = state[np.arange(len(before))[:, None], s[before]]
        before = b[before]
    return before, state


def _packed(m: tuple[np.ndarray, np.ndarray]) -> bytes:
    return np.column_stack((m[0][:, None], m[1])).astype("<i2").tobytes()


def _unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b, "<i2").reshape(-1, 5)
    return a[:, 0], a[:, 1:]


def _scan(maps: list[bytes], vector: int, state: int) -> tuple[list[int], list[int]]:
    """For consecutive segments the vector after and the state before each, given those at the two ends."""
    all_maps = [_unpacked(m) for m in maps]
    vectors = [vector]
    for before, _ in reversed(all_maps[1:]):
        vectors.append(int(before[vectors[-1]]))
    vectors.reverse()
    states = [state]
    for (_, to), v in zip(all_maps[:-1], vectors):
        states.append(int(to[v, states[-1]]))
    return vectors, states


# ---------------------------------------------------------------- Spark ---
BLANKS = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies: the rows as the damage leaves them (a null is one space, conv a string)."""
    conv, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "role"))
    text = F.coalesce("text", F.lit(" "))
    code = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    return rows.select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                       code.alias("code")).where("code <> 0").select(
        "conv", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"),
        F.when(F.col("code") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"))


def _identity() -> tuple[Column, Column]:
    """Digests of a row, and of its role and text alone."""
    said = F.concat_ws(":", F.length("role").cast("string"), "role", F.md5("text"))
    return F.md5(F.concat_ws(":", "conv", F.coalesce(F.col("turn").cast("string"), F.lit(" ")), said)), F.md5(said)


SEGMENTS = ("conv string, part int, seg long, rows array<string>, copies array<long>, symbols binary, blank long, duplicate long, "
            "truncated long, illegal long, first string, last string, low long, high long, turns long")


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in segments of one conversation each; a batch's end also ends a segment."""
    part, number = TaskContext.get().partitionId(), 0
    kinds = {"s": 0, "u": 1, "a": 2}
    legal = {"su", "ua", "au"}
    for whole in it:
        for at in range(0, whole.num_rows, SEGMENT):
            rb = whole.slice(at, SEGMENT).to_pydict()
            out = []
            starts = [i for i, c in enumerate(rb["conv"]) if not i or c != rb["conv"][i - 1]]
            for a, b in zip(starts, [*starts[1:], len(rb["conv"])]):
                initials = [r[:1] for r in rb["role"][a:b]]
                copies = rb["copies"][a:b]
                turns = [t for t in rb["turn"][a:b] if t is not None]
                blank, again, cut = (np.array(rb[c][a:b], bool) for c in ("blank", "again", "cut"))
                symbols = np.array([kinds.get(i, 3) for i in initials], np.int8) + 4 * cut
                symbols[blank | again] = NONE
                n = np.array(copies, np.int64)
                out.append((
                    rb["conv"][a], part, number, rb["row"][a:b], copies, symbols.astype(np.int8).tobytes(), int(n[blank].sum()),
                    int((n - ~again)[~blank].sum()), int((cut & ~blank & ~again).sum()),
                    sum(x + y not in legal for x, y in zip(initials, initials[1:])) + int((n - 1).sum()),
                    initials[0], initials[-1], turns[0] if turns else None, turns[-1] if turns else None,
                    sum(not i or t != turns[i - 1] for i, t in enumerate(turns))))
                number += 1
            yield pa.RecordBatch.from_pydict(dict(zip(
                (c.split()[0] for c in SEGMENTS.split(", ")), (pa.array(c, t) for c, t in zip(zip(*out), _KINDS)))))


_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), *[pa.int64()] * 4,
          pa.string(), pa.string(), *[pa.int64()] * 3]


def segments(rows: DataFrame) -> DataFrame:
    """The damaged conversations as sorted segments (turn, nulls first, then role and text digest)."""
    row, said = _identity()
    blank = ~F.col("text").rlike(rf"[^{BLANKS}]")
    slim = damaged(rows).select(
        "conv", "turn", "role", row.alias("row"), said.alias("said"), F.md5("text").alias("digest"), "copies", blank.alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z")).alias("cut"))
    # equal rows of one turn count as one with its copies: combined before the shuffle
    slim = slim.groupBy("conv", "turn", "role", "row", "said", "digest").agg(
        F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    slim = materialize(slim, "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    repeats = slim.where(~F.col("blank")).groupBy("conv", "said").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # a text said very often in one conversation: its rows are dealt over salted keys
    salts = 16
    repeats = repeats.select("conv", "said", F.col("first").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    marked = slim.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(
        repeats, ["conv", "said", "salt"], "left").withColumn(
        "again", F.coalesce(~F.col("blank") & (place != F.col("first")), F.lit(False)))
    ordered = marked.select("conv", "turn", "role", "digest", "row", "copies", "blank", "cut", "again").repartitionByRange(
        "conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")
    return materialize(ordered.mapInArrow(_cut, SEGMENTS), "repair-segments")


def _maps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in it:
        maps = [_packed(segment_map(np.frombuffer(s, np.int8))) for s in rb.column("symbols").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(rb.column(c) for c in ("conv", "part", "seg")), pa.array(maps, pa.binary())], ["conv", "part", "seg", "map"])


def ends(segs: DataFrame) -> DataFrame:
    """conv, part, seg, vector, state: what a segment of a conversation of several meets at its two ends.

    Maps are composed per partition, scanned over the partitions of a
    conversation (their number bounds the group), and then inside each.
    """
    several = segs.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    maps = materialize(segs.join(several, "conv", "left_semi").select("conv", "part", "seg", "symbols").mapInArrow(
        _maps, "conv string, part int, seg long, map binary"), "repair-maps")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        return pdf.head(1)[["conv", "part"]].assign(map=[_packed(_compose([_unpacked(m) for m in pdf["map"]]))])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        vectors, states = _scan(pdf["map"].tolist(), tables().end, START)
        return pdf[["conv", "part"]].assign(vector=vectors, state=states)

    def inside(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        vectors, states = _scan(pdf["map"].tolist(), int(at.vector.iloc[0]), int(at.state.iloc[0]))
        return pdf[["conv", "part", "seg"]].assign(vector=vectors, state=states)

    parts = maps.groupBy("conv", "part").applyInPandas(whole, "conv string, part int, map binary").groupBy("conv").applyInPandas(
        across, "conv string, part int, vector int, state int")
    return maps.groupBy("conv", "part").cogroup(parts.groupBy("conv", "part")).applyInPandas(
        inside, "conv string, part int, seg long, vector int, state int")


TRACED = ("conv string, part int, seg long, final int, audit string, cost long, "
          "kept array<struct<row:string,n:int,before:string,role:string>>")


def _trace(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = tables()
    ops = [["I" * i + o for o in "DKR"] for i in range(3)]
    before = {(s, i): "".join(line + "\n" for line in TURNS[s][:i]) for s in range(4) for i in range(3)}
    kinds = pa.list_(pa.struct([("row", pa.string()), ("n", pa.int32()), ("before", pa.string()), ("role", pa.string())]))
    for rb in it:
        rows = [np.frombuffer(s, np.int8) for s in rb.column("symbols").to_pylist()]
        matrix = padded(rows)
        vectors = rb.column("vector").fill_null(t.end).to_numpy(zero_copy_only=False)
        state = rb.column("state").fill_null(START).to_numpy(zero_copy_only=False).astype(np.int16)
        after, _ = row_vectors(matrix, vectors)
        states = np.zeros((matrix.shape[1] + 1, len(rows)), np.int16)
        states[0] = state
        for j in range(matrix.shape[1]):
            states[j + 1] = t.to[matrix[:, j], after[:, j], states[j]]
        out = []
        for i, (r, ids, copies) in enumerate(zip(rows, rb.column("rows").to_pylist(), rb.column("copies").to_pylist())):
            at = matrix.shape[1] - len(r)
            s = states[at:-1, i]
            ins, op = t.inserts[r, after[i, at:], s].tolist(), t.op[r, after[i, at:], s].tolist()
            to, s = states[at + 1 :, i].tolist(), s.tolist()
            audit, kept, cost = [], [], 0
            for j, (x, n) in enumerate(zip(r.tolist(), copies)):
                if x == NONE:
                    audit.append("D" * n)
                    cost += DELETE * n
                    continue
                audit.append(ops[ins[j]][op[j]] + "D" * (n - 1))
                cost += INSERT * ins[j] + DELETE * (n - 1) + (DELETE if op[j] == 0 else (op[j] == 2) * REROLE + (x >= 4) * BROKEN)
                if op[j] or ins[j]:
                    role = ("user" if to[j] == ASKED else "assistant") if op[j] == 2 else None
                    kept.append((ids[j], j, before[s[j], ins[j]], role))
            out.append((int(states[-1, i]), "".join(audit), cost, kept))
        yield pa.RecordBatch.from_arrays(
            [*(rb.column(c) for c in ("conv", "part", "seg")), pa.array([o[0] for o in out], pa.int32()),
             pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64()),
             pa.array([[dict(zip(("row", "n", "before", "role"), k)) for k in o[3]] for o in out], kinds)],
            ["conv", "part", "seg", "final", "audit", "cost", "kept"])


def edits(segs: DataFrame) -> DataFrame:
    """Per segment its audit, cost, final state, and the kept rows with the turns inserted before them and their new role."""
    return segs.join(ends(segs), ["conv", "part", "seg"], "left").select(
        "conv", "part", "seg", "rows", "copies", "symbols", "vector", "state").mapInArrow(_trace, TRACED)


RESULT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def _assemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their sorted lines and segment totals, line by line: only one conversation's audit is held."""
    legal = {"su", "ua", "au"}
    columns = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    now, out = None, []

    def close() -> tuple:
        more = CLOSING[now["final"]]
        for line in TURNS[now["final"]][:more]:
            now["hash"].update((("\n" if now["lines"] else "") + line).encode())
            now["lines"] += 1
        gaps = 0 if now["low"] is None else min(now["high"] - now["low"] + 1 - now["turns"], 2**63 - 1)
        return (now["conv"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"] + INSERT * more,
                "".join(now["audit"]) + "I" * more, now["hash"].hexdigest())

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], columns)
        out.clear()
        return b

    for rb in it:
        for x in rb.to_pylist():
            if now is None or x["conv"] != now["conv"]:
                if now is not None:
                    out.append(close())
                now = {"conv": x["conv"], "hash": hashlib.sha256(), "lines": 0, "audit": [], "last": None, "low": None,
                       "high": None, "turns": 0, "final": START} | dict.fromkeys(
                           ("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            if x["line"] is not None:
                now["hash"].update((("\n" if now["lines"] else "") + x["line"]).encode())
                now["lines"] += 1
            if x["audit"] is not None:  # the segment's totals
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[c] += x[c]
                now["illegal"] += now["last"] is not None and now["last"] + x["first"] not in legal
                now["last"], now["final"] = x["last"], x["final"]
                now["audit"].append(x["audit"])
                if x["low"] is not None:
                    now["turns"] += x["turns"] - (now["high"] == x["low"])
                    now["low"] = x["low"] if now["low"] is None else now["low"]
                    now["high"] = x["high"]
        if len(out) >= 1000:
            yield batch()
    if now is not None:
        out.append(close())
    if out:
        yield batch()


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, edits, lines): lines are conv, part, seg, n, line, the repaired ``role:text`` in order of part, seg, n.

    A line may hold several, with turns inserted before the row; the turns
    that close a conversation follow from the last segment's ``final``.
    """
    segs = segments(rows)
    done = materialize(edits(segs), "repair-edits")
    kept = done.select("conv", "part", "seg", F.explode("kept").alias("k")).select("conv", "part", "seg", "k.*")
    row, _ = _identity()
    texts = damaged(rows).select(row.alias("row"), F.col("role").alias("own"), "text").groupBy("row").agg(
        F.first("own").alias("own"), F.first("text").alias("text"))  # copies combine before the shuffle
    lines = kept.withColumnRenamed("conv", "_conv").join(texts, "row").select(
        F.col("_conv").alias("conv"), "part", "seg", "n",
        F.concat("before", F.coalesce("role", "own"), F.lit(":"), "text").alias("line"))
    return segs, done, lines


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per distinct conv_id (null included): gaps, faults, illegal neighbours, cost, audit, repaired_sha256.

    ``rows``: (conv_id, turn, role, text). Rows are damaged first (see
    ``damaged``), then repaired at the least cost. Order in a conversation:
    turn (nulls first), then role, then the text's md5, so that equal rows
    stand together. A row's first fault counts: blank, duplicate (role and
    text seen earlier), truncated. A conversation without rows has zeros, an
    empty audit and the empty string's digest. Nulls are one space; a role
    counts by its first character; other columns are ignored; an empty table
    gives an empty result. A gap count beyond a long is the largest long.

    A digest is sequential, so one task reads all kept lines of a
    conversation, as a stream; everything before it is spread by segments.
    """
    segs, done, lines = repaired(rows)
    totals = done.join(segs.select("conv", "part", "seg", "blank", "duplicate", "truncated", "illegal", "first", "last", "low",
                                   "high", "turns"), ["conv", "part", "seg"])
    columns = ["final", "audit", "cost", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns"]
    kinds = dict(totals.dtypes)
    marks = totals.select("conv", "part", "seg", F.lit(SEGMENT).alias("n"), F.lit(None).cast("string").alias("line"), *columns)
    both = marks.unionByName(lines.select("conv", "part", "seg", "n", "line", *[F.lit(None).cast(kinds[c]).alias(c) for c in columns]))
    found = both.repartition("conv").sortWithinPartitions("conv", "part", "seg", "n").mapInArrow(_assemble, RESULT)
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn(
        "conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "conv", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
