import random
import zlib
from collections import defaultdict

import numpy as np
from llm.helpers import edge_docs, edge_rows, no_docs
from ordlens.llm import packing
from ordlens.llm.plans import tokenizer_path
from tokenizers import Tokenizer


def check_plan(hist, cap):
    seqs, ranks = defaultdict(list), defaultdict(set)
    for length, a, b, s, at in packing.plan(hist, cap):
        for i in range(b - a):
            assert a + i not in ranks[length]
            ranks[length].add(a + i)
            seqs[s + i].append((at, length))
    assert {k: len(v) for k, v in ranks.items()} == hist
    for items in seqs.values():
        end = 0
        for at, n in sorted(items):
            assert at == end
            end += n
        assert end <= cap.tokens and len(items) <= cap.documents and sum(n * n for _, n in items) <= cap.cost
    return len(seqs)


def test_plan_keeps_every_constraint():
    r = random.Random(1)
    for rule in ("norm", "dot"):
        for docs, cost in ((100, 100 * 100), (3, 100 * 100), (100, 4000)):
            hist = {n: r.randint(1, 40) for n in r.sample(range(1, 61), 25)}
            check_plan(hist, packing.Capacity(100, docs, cost, rule))
    assert packing.plan({}, packing.Capacity()) == []


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    lengths, counts = np.unique(np.minimum(rng.lognormal(6, 1.2, 20_000).astype(int) + 1, 4096), return_counts=True)
    n = check_plan(dict(zip(lengths.tolist(), counts.tolist())), packing.Capacity())
    assert n <= 1.005 * -(-int((lengths * counts).sum()) // 4096)


def test_pieces_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 2)
    lib = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(edge_docs(spark), tokenizer_path(), packing.Capacity(512, 512, 512 * 512)).collect()
    want = []
    for doc, text, *_ in edge_rows():
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(doc), i, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes()))
                 for i, s in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for items in seqs.values():
        assert [at for at, _ in sorted(items)] == [sum(n for a, n in items if a < at) for at, _ in sorted(items)]
    assert packing.pack(no_docs(spark), tokenizer_path()).count() == 0
