"""Near-duplicate documents by b-bit MinHash.

1. Each document's distinct word shingles are hashed; ``bands x rows`` minima
   give ``bands`` band keys, and the low ``BITS`` bits of every minimum are
   packed into 64-bit words (the b-bit signature).
2. Documents with the same shingle set form a class; only its smallest id goes on.
3. Band candidates: in each bucket every member is paired with the smallest
   and the largest id (a star, never all pairs). A pair whose similarity,
   estimated from the bit counts and corrected for chance collisions, lies
   ``SLACK`` standard errors under the threshold is dropped; the rest is
   confirmed on the full sets.
4. Components over the confirmed links. Documents of buckets that still hold
   several components get an exact pass: members of different components are
   compared block by block, first on signatures, then on full sets, and the
   components are closed again.
   So no link between two documents that share a bucket is lost, and copies
   are never expanded into all pairs.

The number of bands is chosen so that a pair at the threshold misses every
bucket with a probability below ``MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlens.llm.graph import components
from ordlens.llm.shingles import mix, shingle_sets
from ordlens.llm.tokens import release_memory
from ordlens.session import materialize

ROWS = 4
MISS = 1e-9
BITS = 2
SLACK = 6.0
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 18
BATCH = 2 << 20
_SEED = 71


def plan_bands(num: int, den: int) -> int:
    """Bands of ``ROWS`` rows (a multiple of 8) that miss a pair at num/den with P < MISS."""
    hit = (num / den) ** ROWS
    need = 1 if hit >= 1 else math.ceil(math.log(MISS) / math.log1p(-hit))
    return max(8, -(-need // 8) * 8)


def batches(it: Iterator[pa.RecordBatch], column: str, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about ``size`` characters of text, or one row."""
    for rb in it:
        sizes = np.cumsum(pc.utf8_length(rb.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < rb.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + size, "right")))
            yield rb.slice(at, to - at)
            at = to


def set_digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set (0 for an empty one), whatever the order of its elements."""
    n = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(n)
    a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    if len(some):
        flat = np.concatenate([sets[i] for i in some])
        cuts = np.concatenate(([0], np.cumsum(n[some])[:-1]))
        a[some] = mix(np.add.reduceat(flat, cuts))
        b[some] = mix(np.add.reduceat(mix(flat ^ np.uint64(_SEED)), cuts))
    return a.view(np.int64), b.view(np.int64)


def _sign(k: int, bands: int):
    words = bands * ROWS * BITS // 64

    def run(it):
        rng = np.random.default_rng(_SEED)
        mult = rng.integers(1, 2**63, bands * ROWS, dtype=np.uint64) | np.uint64(1)
        weight = rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
        place = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
        for rb in batches(it, "text"):
            sets = shingle_sets(rb.column("text").to_pylist(), k)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            minima = np.zeros((len(sets), bands * ROWS), np.uint64)
            set_a, set_b = set_digests(sets)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                cuts = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                for j, m in enumerate(mult):
                    minima[some, j] = np.minimum.reduceat(flat * m, cuts)
            key = mix((minima.reshape(-1, bands, ROWS) * weight).sum(2, dtype=np.uint64))
            low = (minima >> np.uint64(20)) & np.uint64((1 << BITS) - 1)
            sig = (low.reshape(len(sets), words, 64 // BITS) << place).sum(2, dtype=np.uint64)

            def lists(a):
                return pa.ListArray.from_arrays(
                    pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.view(np.int64).ravel()))

            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(set_a), pa.array(set_b), lists(key), lists(sig)],
                ["doc_id", "n", "set_a", "set_b", "bands", "sig"])
        release_memory()

    return run


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """(doc_id, n, set_a, set_b, bands, sig): set size, two digests of the set, band keys, packed low bits."""
    return docs.select("doc_id", "text").mapInArrow(
        _sign(k, bands), "doc_id long, n long, set_a long, set_b long, bands array<long>, sig array<long>")


def estimate(a: str, b: str, bands: int):
    """Collision-corrected similarity of two packed signatures, from their bit counts."""
    odd = 0x5555555555555555

    def differing(x, y):
        d = x.bitwiseXOR(y)
        return F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1))).bitwiseAND(F.lit(odd)))

    bad = sum((differing(F.col(a)[i], F.col(b)[i]) for i in range(bands * ROWS * BITS // 64)), F.lit(0))
    match = 1 - bad / F.lit(float(bands * ROWS))
    chance = 2.0**-BITS
    return (match - chance) / (1 - chance)


def cutoff(num: int, den: int, bands: int) -> float:
    """Estimates below this are no links: ``SLACK`` standard errors under the threshold."""
    chance = 2.0**-BITS
    p = num / den * (1 - chance) + chance
    return num / den - SLACK * math.sqrt(p * (1 - p) / (bands * ROWS)) / (1 - chance)


def _confirm(k: int, num: int, den: int):
    def run(it):
        centre_id, centre, out = None, None, []
        for rb in batches(it, "text"):
            sets = shingle_sets(rb.column("text").to_pylist(), k)
            a, b = rb.column("a").to_pylist(), rb.column("b").to_pylist()
            out = []
            for x, y, s in zip(a, b, sets):
                if y is None:
                    centre_id, centre = x, ([s] if centre_id != x else [*centre, s])
                elif centre_id == x:
                    for c in centre:
                        both = len(np.intersect1d(c, s, assume_unique=True))
                        if both and den * both >= num * (len(c) + len(s) - both):
                            out.append((x, y))
                            break
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])
        release_memory()

    return run


def confirm(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) pairs whose full shingle sets reach num/den.

    Texts of the partners travel to their ``a`` once per pair; a hub's
    partners are spread over salts of 64 and only the hub's own text is
    repeated, once per salt. Each task streams over its rows and holds one
    hub's set at a time.
    """
    pairs = pairs.select("a", "b")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).alias("salts"))
    centre = hubs.join(docs.select(F.col("doc_id").alias("a"), "text"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)).alias("salt"),
        F.lit(None).cast("long").alias("b"), "text")
    partner = pairs.join(hubs, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b").join(
        docs.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "salt", "b", "text")
    rows = centre.unionByName(partner).repartition("a", "salt").sortWithinPartitions(
        "a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_confirm(k, num, den), "a long, b long").distinct()


def _sets_of(k: int):
    def run(it):
        for rb in batches(it, "text"):
            sets = shingle_sets(rb.column("text").to_pylist(), k)
            a, b = set_digests(sets)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(a), pa.array(b), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "set_a", "set_b", "shingles"])
        release_memory()

    return run


def _links(rows: list[tuple], bands: int, floor: float, num: int, den: int) -> list[tuple[int, int]]:
    """Links between different labels of one cell: signatures choose the pairs, bit sets of shared shingles decide.

    Of the links that join the same labels one is enough.
    """
    doc, label, n, role = (np.array([r[i] for r in rows]) for i in range(4))
    sig = np.array([r[4] for r in rows], np.int64).view(np.uint64)
    sets = [np.frombuffer(r[5], np.uint64) for r in rows]
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1
    owner = np.repeat(np.arange(len(rows)), [len(s) for s in sets])
    keep = seen[code] > 1
    at = shared[code[keep]]
    bits = np.zeros((len(rows), (int(shared[-1]) >> 6) + 1), np.uint64)
    np.bitwise_or.at(bits, (owner[keep], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    odd, one, chance = np.uint64(0x5555555555555555), np.uint64(1), 2.0**-BITS
    root = {x: x for x in set(label.tolist())}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i in np.flatnonzero(role & 1):
        d = sig ^ sig[i]
        bad = np.bitwise_count((d | (d >> one)) & odd).sum(1)
        ok = ((1 - bad / (bands * ROWS) - chance) / (1 - chance) >= floor) & (label != label[i]) & (role & 2 > 0) & (
            den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))
        js = np.flatnonzero(ok)
        for part in np.split(js, range(256, len(js), 256)):
            both = np.bitwise_count(bits[part] & bits[i]).sum(1, dtype=np.int64)
            for j in part[den * both >= num * (n[part] + n[i] - both)]:
                x, y = find(int(label[i])), find(int(label[j]))
                if x != y:
                    root[x] = y
                    out.append((int(min(doc[i], doc[j])), int(max(doc[i], doc[j]))))
    return out


def _cross(bands: int, floor: float, num: int, den: int):
    def table(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    def run(it):
        key, rows = None, []
        for rb in it:
            for family, i, j, role, doc, label, n, sig, shingles in zip(*(c.to_pylist() for c in rb.columns)):
                if (family, i, j) != key:
                    if rows:
                        yield table(_links(rows, bands, floor, num, den))
                    key, rows = (family, i, j), []
                rows.append((doc, label, n, role, sig, shingles))
        if rows:
            yield table(_links(rows, bands, floor, num, den))
        release_memory()

    return run


def cross_links(open_: DataFrame, reps: DataFrame, docs: DataFrame, k: int, bands: int, floor: float, num: int,
                den: int) -> DataFrame:
    """Links (a, b) between components that meet in a bucket of ``open_`` (band, bucket, doc_id, label).

    Documents that share open buckets, directly or through others, are a
    family. In each family the largest component is the major one, and only
    pairs with a member of a minor component on one side are compared. Both
    sides are hashed into blocks of about ``BLOCK_ROWS`` rows and
    ``BLOCK_SHINGLES`` shingles, and every (minor block, block) meets in one
    cell: a family of any size is spread over tasks of bounded size, and only
    links come out of them.
    """
    hub = open_.groupBy("band", "bucket").agg(F.min("doc_id").alias("hub"))
    family = components(open_.join(hub, ["band", "bucket"]).where("hub <> doc_id").select(
        F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()).toDF("doc_id", "family")
    # a doc_id with several texts takes part with each of their sets
    m = family.join(open_.select("doc_id", "label").distinct(), "doc_id").join(
        reps.select("doc_id", "set_a", "set_b", "n", "sig").dropDuplicates(["doc_id", "set_a", "set_b"]), "doc_id").select(
        "family", "doc_id", "set_a", "set_b", "label", "n", "sig")
    sizes = m.groupBy("family", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK_ROWS, s / BLOCK_SHINGLES)).cast("int")
    per = sizes.groupBy("family").agg(
        F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "s", "label")).alias("major"),
        F.count("*").alias("labels")).where("labels > 1").select(
        "family", F.col("major.label").alias("major"),
        blocks(F.col("c") - F.col("major.c"), F.col("s") - F.col("major.s")).alias("mb"),
        blocks(F.col("major.c"), F.col("major.s")).alias("nb"))
    m = m.join(per, "family").withColumn("minor", F.col("label") != F.col("major")).withColumn(
        "own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("minor"), F.col("mb")).otherwise(F.col("nb"))).cast("int"))
    # blocks 0..mb-1 are minor, mb..mb+nb-1 major; role 1 = left side, 2 = right side, 3 = both
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    minors, all_ = F.sequence(F.lit(0), F.col("mb") - 1), F.sequence(F.lit(0), F.col("mb") + F.col("nb") - 1)
    own = F.col("own")
    cells = F.when(F.col("minor"), F.concat(
        F.transform(F.filter(all_, lambda j: j > own), lambda j: cell(own, j, 1)),
        F.array(cell(own, own, 3)),
        F.transform(F.filter(minors, lambda i: i < own), lambda i: cell(i, own, 2)),
    )).otherwise(F.transform(minors, lambda i: cell(i, F.col("mb") + own, 2)))
    sets = docs.join(m.select("doc_id").distinct(), "doc_id").mapInArrow(
        _sets_of(k), "doc_id long, set_a long, set_b long, shingles binary").dropDuplicates(["doc_id", "set_a", "set_b"])
    rows = m.join(sets, ["doc_id", "set_a", "set_b"]).select("family", F.explode(cells).alias("cell"), "doc_id", "label", "n", "sig", "shingles")
    rows = rows.select("family", "cell.i", "cell.j", "cell.role", "doc_id", "label", "n", "sig", "shingles").repartition(
        "family", "i", "j").sortWithinPartitions("family", "i", "j")
    return rows.mapInArrow(_cross(bands, floor, num, den), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept.

    Links: ``den * |A n B| >= num * |A u B|`` on sets of ``shingle``-word
    shingles. ``component_id`` is the smallest doc_id reachable over links,
    ``kept`` marks the row that carries it. Null or empty text: no shingles,
    linked with nothing. Rows of one doc_id are one node, linked through any
    of their texts (each row returns; all are kept if the id is the smallest).
    A null doc_id takes no part: component_id null, kept true. Any other
    columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    bands = plan_bands(num, den)
    floor = cutoff(num, den, bands)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = materialize(signatures(docs, shingle, bands), "mh-sig")
    live = sig.where("doc_id is not null and n > 0")
    classes = live.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    same = live.join(classes, ["set_a", "set_b", "n"]).where("doc_id <> rep").select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    same = materialize(same, "mh-same")
    reps = live.select("doc_id", "set_a", "set_b", "n", "bands", "sig").join(
        same.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti")
    # a doc_id with several sets is a member of a class and may also stand for one of its own
    again = materialize(live.groupBy("doc_id").agg(F.count_distinct("set_a", "set_b").alias("sets")).where(
        "sets > 1").select("doc_id"), "mh-again")
    if not again.isEmpty():
        reps = reps.union(live.join(again, "doc_id", "left_semi").select("doc_id", "set_a", "set_b", "n", "bands", "sig")).distinct()
    reps = materialize(reps, "mh-reps")
    member = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    buckets = member.groupBy("band", "bucket").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c")).where("lo < hi")
    full = materialize(member.join(buckets, ["band", "bucket"]), "mh-buckets")
    ends = F.array(F.struct(F.col("lo").alias("a"), F.col("doc_id").alias("b")),
                   F.struct(F.col("doc_id").alias("a"), F.col("hi").alias("b")))
    star = full.select(F.explode(ends).alias("p")).select("p.a", "p.b").where("a < b").distinct()
    likely = materialize(_plausible(star, reps, bands, floor, num, den), "mh-likely")
    # texts move once; whatever is compared later reads this smaller table
    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(
        full.where("c > 3").select("doc_id")).distinct()
    docs = materialize(docs.join(wanted, "doc_id", "left_semi"), "mh-texts")
    links = materialize(confirm(likely, docs, shingle, num, den), "mh-links")
    labels = components(links.union(same))
    more = materialize(cross_links(_open(full, labels), reps, docs, shingle, bands, floor, num, den), "mh-cross")
    if not more.isEmpty():
        labels = _lift(labels, more)
    return sig.select("doc_id", F.col("n").alias("n_shingles")).join(
        labels.select(F.col("node").alias("doc_id"), F.col("label").alias("component_id")), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _open(full: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (band, bucket, doc_id, label) of the buckets that hold several components and an untested pair."""
    m = full.where("c > 3").select("band", "bucket", "doc_id").join(
        labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn(
        "label", F.coalesce("label", "doc_id"))
    mixed = m.groupBy("band", "bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1")
    return materialize(m.join(mixed.select("band", "bucket"), ["band", "bucket"]), "mh-open")


def _lift(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    between = links.join(la, "a", "left").join(lb, "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    top = components(between).toDF("label", "top")
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return materialize(labels.union(fresh).join(top, "label", "left").select(
        "node", F.coalesce("top", "label").alias("label")), "mh-labels")


def _plausible(pairs: DataFrame, reps: DataFrame, bands: int, floor: float, num: int, den: int) -> DataFrame:
    """Pairs whose set sizes and estimated similarity allow a link."""
    x = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    return pairs.join(x, "a").join(y, "b").where(
        (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (estimate("sa", "sb", bands) >= floor)
    ).select("a", "b").distinct()
