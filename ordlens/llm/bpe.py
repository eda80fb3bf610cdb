"""BPE encoding and decoding through a distinct-word table.

1. Texts are split into white-space words block by block; a block keeps each
   text as positions into its own list of distinct words.
2. The lists of all blocks, dealt by word hash, meet in the distinct-word
   table: there every distinct word is encoded once, and its ids go back to
   each block that has it.
3. The ids that a block uses are joined with the table id -> piece.
4. Per block, positions give each text's ids, and ids give its pieces.

Texts themselves never move: only positions, distinct words and ids do.
"""

from __future__ import annotations

import hashlib
import lzma
import os
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordlens.llm.minhash import batches
from ordlens.llm.tokens import WordEncoder, ragged, release_memory, split_words
from ordlens.session import materialize, scratch_path

#: Characters of text in a block (a longer text is a block of its own).
BLOCK_CHARS = 12 << 20

_LZMA = {step: [{"id": lzma.FILTER_LZMA2, "preset": 0, "lp": step, "lc": 0, "pb": step}] for step in (1, 2)}

BLOCKS = ("block long, bucket int, rows array<long>, row_null array<boolean>, counts array<int>, repeated int, "
          "places binary, words binary")
ENTRIES = "block long, places binary, counts binary, ids binary, used binary"


def pack(a: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def pack_ids(ids: np.ndarray) -> bytes:
    """Token ids, whose sequences recur in like words: LZMA on their two or four bytes each."""
    kind, step = ("<u2", 1) if not len(ids) or ids.max() < 1 << 16 else ("<u4", 2)
    return bytes([step]) + lzma.compress(ids.astype(kind).tobytes(), lzma.FORMAT_RAW, filters=_LZMA[step])


def unpack_ids(b: bytes) -> np.ndarray:
    raw = lzma.decompress(b[1:], lzma.FORMAT_RAW, filters=_LZMA[b[0]])
    return np.frombuffer(raw, "<u2" if b[0] == 1 else "<u4").astype(np.uint32)


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _steps(a: np.ndarray) -> np.ndarray:
    """Ascending integers as their first differences."""
    return np.diff(a, prepend=0)


def _split(buckets: int):
    def run(it):
        part, n = TaskContext.get().partitionId(), 0
        for rb in batches(it, "text", BLOCK_CHARS):
            offsets, codes, words = split_words(rb.column("text"))
            block, n = (part << 32) + n, n + 1
            # places: words that repeat in the block by frequency, then the others as they come, which need no position
            seen = np.bincount(codes, minlength=len(words))
            often = np.flatnonzero(seen > 1)
            by_place = np.concatenate((often[np.argsort(-seen[often], kind="stable")], np.flatnonzero(seen == 1)))
            place = np.zeros(len(words), np.int64)
            place[by_place] = np.arange(len(words))
            ids = rb.column("doc_id")
            rows = [(block, -1, ids.fill_null(0).to_pylist(), ids.is_null().to_pylist(), np.diff(offsets).tolist(), len(often),
                     pack(np.where(seen[codes] == 1, 0, place[codes] + 1)), None)]
            words = [words[i] for i in by_place]
            home = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(home, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
                rows.append((block, int(home[some[0]]), None, None, None, None, pack(_steps(some)),
                             zstandard.compress("\n".join([words[i] for i in some]).encode(), 9)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int32(),
                    pa.binary(), pa.binary()))],
                ["block", "bucket", "rows", "row_null", "counts", "repeated", "places", "words"])
            release_memory()

    return run


def _encode(path: str):
    def run(it):
        bucket_now, t = None, WordEncoder(path, None)
        for rb in it:
            out = []
            for block, bucket, places, words in zip(*(rb.column(c).to_pylist() for c in ("block", "bucket", "places", "words"))):
                if bucket != bucket_now:  # rows come sorted by bucket: one bucket's distinct words at a time
                    t.clear()
                    bucket_now = bucket
                at = t.places(zstandard.decompress(words).decode().split("\n"))
                count, ids = t.words.count[at], t.words.gather(at)
                out.append((block, places, pack(count), pack_ids(ids), pack(_steps(np.unique(ids).astype(np.int64)))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3, 4))],
                ["block", "places", "counts", "ids", "used"])
        del t
        release_memory()

    return run


def _used(it):
    """The distinct ids of each block, from the packed lists of its entries."""
    for rb in it:
        for block, lists in zip(rb.column("block").to_pylist(), rb.column("used").to_pylist()):
            u = np.unique(np.concatenate([np.cumsum(unpack(x), dtype=np.int64) for x in lists])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), block)), pa.array(u)], ["block", "id"])


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of a tokenizer file: as many rows as its vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = sorted((i, p) for p, i in t.get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text): per block one row of positions and one row of distinct words per bucket.

    The table is bucketed by block, so positions are read where they lie and
    never shuffled. It is a plain folder of the checkpoint directory; the
    catalogue's entry only serves to write and read the buckets and goes again.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_split(buckets), BLOCKS)
    path = scratch_path(spark, "bpe-blocks")
    name = f"bpe_blocks_{os.path.basename(path).rsplit('-', 1)[1]}"
    rows.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    blocks = spark.table(name)
    blocks.schema  # resolved now: the folder and its buckets  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return blocks


def word_table(blocks: DataFrame, path: str) -> DataFrame:
    """For each block and bucket the ids of its words; each distinct word of the corpus is encoded once."""
    return materialize(
        blocks.where("bucket >= 0").select("block", "bucket", "places", "words").repartition("bucket").sortWithinPartitions(
            "bucket").mapInArrow(_encode(path), ENTRIES), "bpe-words")


def assemble(blocks: DataFrame, entries: DataFrame, pieces: DataFrame, reader: Callable, schema: str) -> DataFrame:
    """``reader(doc_ids, null, counts, places, word_count, word_start, ids, piece_of)`` -> DataFrame, for each block.

    ``pieces`` (id, piece) is joined with the distinct ids of each block.
    """
    lists = entries.groupBy("block").agg(F.collect_list("used").alias("used"))  # one block: a small list per bucket
    used = lists.mapInArrow(_used, "block long, id int").join(pieces, "id").groupBy("block").agg(
        F.collect_list(F.struct("id", "piece")).alias("p"))  # one block: the vocabulary at most
    none = F.lit(None)
    known = entries.select("block", "places", "counts", "ids", none.cast("array<int>").alias("used"),
                           none.cast("array<string>").alias("pieces")).unionByName(used.select(
        "block", none.cast("binary").alias("places"), none.cast("binary").alias("counts"), none.cast("binary").alias("ids"),
        F.col("p.id").alias("used"), F.col("p.piece").alias("pieces")))

    def join(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        piece_of: dict[int, str] = {}
        lists: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for c, k, i, u, p in zip(words.places, words.counts, words.ids, words.used, words.pieces):
            if c is None:
                piece_of.update(zip(u, p))
            else:
                for to, x in zip(lists, (np.cumsum(unpack(c), dtype=np.int64), unpack(k).astype(np.int64), unpack_ids(i))):
                    to.append(x)
        place, n, ids = (np.concatenate(x) for x in lists)
        count, start = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], start[place] = n, np.cumsum(n) - n
        out = []
        for rows, null, words_of, repeated, packed in zip(docs.rows, docs.row_null, docs.counts, docs.repeated, docs.places):
            at = unpack(packed).astype(np.int64) - 1
            once = at < 0
            at[once] = repeated + np.arange(once.sum())
            null = np.asarray(null, bool)
            out.append(reader(pd.array(np.where(null, 0, rows), "Int64"), null, np.asarray(words_of), at, count, start, ids,
                              piece_of))
        del place, n, ids, count, start, lists
        release_memory()
        return pd.concat(out)

    docs = blocks.where("bucket = -1").select("block", "rows", "row_null", "counts", "repeated", "places")
    return docs.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(join, schema)


def _digests(doc_ids, null, n, at, count, start, ids, piece_of) -> pd.DataFrame:
    """Token count and digests of ids and decoded text of each document of a block."""
    doc_ids[null] = pd.NA
    flat = ids[ragged(start, count)].tolist()
    cuts = np.concatenate(([0], np.cumsum(count))).tolist()
    as_ids = [" ".join(map(str, flat[a:b])) for a, b in zip(cuts, cuts[1:])]
    as_text = [" ".join([piece_of[i] for i in flat[a:b]]) for a, b in zip(cuts, cuts[1:])]
    kept = count[at] > 0
    ends = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(n)))].tolist()
    tokens = np.concatenate(([0], np.cumsum(count[at])))[np.concatenate(([0], np.cumsum(n)))]
    words = at[kept].tolist()
    digest = lambda parts: [hashlib.sha256(" ".join(map(parts.__getitem__, words[a:b])).encode()).hexdigest()
                            for a, b in zip(ends, ends[1:])]
    return pd.DataFrame({"doc_id": doc_ids, "n_tokens": np.diff(tokens), "ids_sha256": digest(as_ids),
                         "decoded_sha256": digest(as_text)})


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text).

    Null and empty texts have no tokens (the digests are those of the empty
    string). Null ids and repeated rows come back as they are, other columns
    are ignored, an empty table gives an empty result. Decoding joins the
    pieces by a space, as a file without decoder does.
    """
    blocks = word_blocks(docs)
    return assemble(blocks, word_table(blocks, path), vocabulary(docs.sparkSession, path), _digests,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(doc_ids, null, n, at, count, start, ids, piece_of) -> pd.DataFrame:
    doc_ids[null] = pd.NA
    flat = ids[ragged(start[at], count[at])].astype(np.int32)
    cuts = np.concatenate(([0], np.cumsum(count[at])))[np.concatenate(([0], np.cumsum(n)))]
    each = [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    return pd.DataFrame({"doc_id": doc_ids, "ids": each, "decoded": [" ".join([piece_of[i] for i in x]) for x in each]})


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded of every row of ``docs``: the ids and the decoded text themselves."""
    blocks = word_blocks(docs)
    return assemble(blocks, word_table(blocks, path), vocabulary(docs.sparkSession, path), _texts,
                    "doc_id long, ids array<int>, decoded string")
