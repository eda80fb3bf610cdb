import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
from ordlens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, line int"
WHITE = " \t\n\v\f\r"


def brute(rows):
    """Every conversation by a direct recursion over all edit scripts."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = set()
    for conv, r in convs.items():
        r.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in r:
            body = text.rstrip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))

        def after(state, who):
            return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, who))

        @lru_cache(None)
        def best(i, state, run=0):
            found = [(0, "", ())] if i == len(r) and state in ("", "a") else []

            def put(cost, op, line, to, j, run=0):
                if to is not None and (rest := best(j, to, run)):
                    found.append((cost + rest[0], op + rest[1], line + rest[2]))

            if run < 3:
                for who in ("user", "assistant"):
                    put(5, "I", (who + ":",), after(state, who[0]), i, run + 1)
            if i < len(r):
                _, role, text = r[i]
                put(2, "D", (), state, i + 1)
                if faults[i] in ("", "truncated"):
                    more = 5 * (faults[i] == "truncated")
                    put(more, "K", (f"{role}:{text}",), after(state, role[:1]), i + 1)
                    for who in ("user", "assistant"):
                        put(1 + more, "R", (f"{who}:{text}",), after(state, who[0]), i + 1)
            return min(found, default=None)

        for i in range(len(r), -1, -1):  # from the end, so that the recursion stays shallow
            for state in ("", "s", "u", "a"):
                best(i, state)
        cost, audit, lines = best(0, "")
        turns = {t for t, _, _ in r if t is not None}
        bad = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(r, r[1:]))
        out.add((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (
            "blank", "duplicate", "truncated")), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations(seed, convs=60):
    r = random.Random(seed)
    texts = ["Hi.", "Yes?", "No", "", " \t", None, "Fine! ", "a.b", "...", "Ünï.", "é\x85", "ok.\x0b"]
    rows = []
    for c in range(convs):
        for t in range(r.choice((0, 1, 2, 5, 30))):
            turn = None if r.random() < 0.1 else r.choice((t, t, t, t + 3, -t))
            rows.append((c, turn, r.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None, "sys")), r.choice(texts)))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (-7, 2**62, "user", "x."), (-7, 4, "assistant", "y.")]
    rows += [(900, 5, "user", "Same.")] * 40 + [(901, i % 9, "assistant", "Same.") for i in range(200)]
    rows += [(902, i, ("user", "assistant", "assistant")[i % 3], f"Turn {i}{'.' * (i % 5 > 0)}") for i in range(150)]
    r.shuffle(rows)
    return rows


def test_matches_brute_force_with_tiny_segments(spark, monkeypatch):
    rows = conversations(1)
    df = spark.createDataFrame([(*x, "q", None) for x in rows], SCHEMA)
    expected = brute(rows)
    assert len(expected) > 50
    assert {tuple(x) for x in repair.repair_digests(df).collect()} == expected
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # conversations over many segments and partitions
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert repair.segments(df).groupBy("conv").count().where("count > 5").count() > 0
        assert {tuple(x) for x in repair.repair_digests(df).collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_table_and_conversation_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_digests(empty).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair_digests(spark.createDataFrame([(dropped, 0, "user", "Hi.", None, None)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_block_lookup_equals_single_steps_and_maps_compose():
    t, r = repair.tables(), np.random.default_rng(2)
    rows = r.integers(0, 9, (50, 24)).astype(np.int8)
    for end in range(len(t.vectors)):
        after, before = repair.row_vectors(rows, np.full(50, end))
        v = np.full(50, end)
        for j in range(23, -1, -1):
            assert (after[:, j] == v).all()
            v = t.move[rows[:, j], v]
        assert (before == v).all()
    whole = repair.segment_map(rows[0])
    parts = [repair.segment_map(rows[0, a:b]) for a, b in ((0, 3), (3, 17), (17, 24))]
    joined = repair._compose(parts)
    assert (joined[0] == whole[0]).all() and (joined[1] == whole[1]).all()
