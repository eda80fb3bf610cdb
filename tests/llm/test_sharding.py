from collections import defaultdict

from llm.helpers import edge_docs, edge_rows, no_docs
from ordlens.llm.sharding import extendible_shards


def check(rows, limit):
    sizes, counts = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.n_bytes
        counts[r.shard] += 1
        assert len(r.shard) == r.depth
    for r in rows:
        assert (r.shard_bytes, r.shard_rows) == (sizes[r.shard], counts[r.shard])
        assert r.shard_bytes <= limit or r.shard_rows == 1
    for a in sizes:  # buckets do not contain each other
        assert not any(b != a and b.startswith(a) for b in sizes)
    return sizes


def test_only_oversized_buckets_split(spark):
    docs = spark.createDataFrame([(i, "x" * (1 + i % 50)) for i in range(2000)], "doc_id long, text string")
    sizes = check(extendible_shards(docs, 3000).collect(), 3000)
    parents = defaultdict(int)
    for s, b in sizes.items():
        for d in range(len(s)):
            parents[s[:d]] += b
    assert all(b > 3000 for b in parents.values())
    assert extendible_shards(docs, 10**9).select("shard").distinct().collect()[0][0] == ""


def test_one_key_with_most_rows(spark):
    docs = spark.createDataFrame([(7, "y" * 10)] * 600 + [(i, "z") for i in range(300)], "doc_id long, text string")
    rows = extendible_shards(docs, 200).collect()
    assert len(rows) == 900
    check(rows, 200)


def test_edge_rows(spark):
    rows = extendible_shards(edge_docs(spark), 1000).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in rows) == sorted((str(r[0]), len((r[1] or "").encode())) for r in edge_rows())
    check(rows, 1000)
    assert extendible_shards(no_docs(spark), 1000).count() == 0


def test_climb_equals_direct_directory(spark):
    """Every bucket is the shortest prefix whose bytes fit, and no round of the climb sums over more than 2^STEP nodes."""
    import hashlib

    docs = spark.createDataFrame([(i, "x" * (1 + (i * 7) % 90)) for i in range(3000)], "doc_id long, text string")
    size = {i: 1 + (i * 7) % 90 for i in range(3000)}
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i in size}
    for limit in (100, 1500, 40_000, 10**6):
        below = defaultdict(lambda: [0, 0])
        for i, b in bits.items():
            for d in range(41):
                below[b[:d]][0] += size[i]
                below[b[:d]][1] += 1
        want = {i: next(b[:d] for d in range(41) if below[b[:d]][0] <= limit or below[b[:d]][1] == 1) for i, b in bits.items()}
        assert {r.doc_id: r.shard for r in extendible_shards(docs, limit).collect()} == want
