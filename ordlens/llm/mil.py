"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by numbers on its
bytes and words, then by a tanh layer; gated attention (tanh times sigmoid)
weighs the passages, and a logistic head scores the weighted mean of their
representations. All weights are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordlens.llm.minhash import batches
from ordlens.llm.shingles import word_spans
from ordlens.llm.tokens import release_memory

#: Words in a passage.
PASSAGE = 64
#: Buckets of hashed words.
HASHED = 24
#: The fit takes at most so many labelled documents, of any length.
MAX_FIT_DOCS = 6000
#: Predicted good from this score on.
THRESHOLD = 0.3

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "#*$%&<>@^~=+_\\", "|",
            "\"'()[]{}-/`"]


def _class_table() -> np.ndarray:
    t = np.full(256, len(_CLASSES), np.int64)
    for i, chars in enumerate(_CLASSES):
        t[[ord(c) for c in chars]] = i
    t[128:] = len(_CLASSES) + 1
    return t


_CLASS = _class_table()
N_CLASSES = len(_CLASSES) + 2
_PACKED = [(np.uint64(1) * (_CLASS == i) + (np.uint64(1) << np.uint64(32)) * (_CLASS == i + 1)).astype(np.uint64)
           for i in range(0, N_CLASSES, 2)]
_PACKED = [p * ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]) for p in _PACKED]  # white space lies in no word
FEATURES = N_CLASSES + 5 + HASHED


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of the texts, and each text's number of passages.

    Per passage: shares of byte classes; words that repeat the one before;
    distinct words; mean and largest word length; how full the passage is;
    signed shares of hashed words. A text without words is one row of zeros.
    """
    data, start, end, hashes, counts = word_spans(texts)
    per = np.maximum(-(-counts // PASSAGE), 1)
    first_row = np.cumsum(per) - per
    rows = int(per.sum())
    out = np.zeros((rows, FEATURES), np.float32)
    if not len(start):
        return out, per
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
    row, slot = first_row[doc] + order // PASSAGE, order % PASSAGE
    head = np.flatnonzero(slot == 0)
    some = row[head]
    n = np.diff(np.concatenate((head, [len(start)])))
    size = end - start
    chars = np.add.reduceat(size, head)
    # two 32-bit byte counts in each sum
    edges = np.column_stack((start[head], end[head + n - 1])).ravel()
    for i, packed in enumerate(_PACKED):
        sums = np.add.reduceat(packed[data], edges)[::2]
        for j in (0, 1):
            if 2 * i + j < N_CLASSES:
                out[some, 2 * i + j] = ((sums >> np.uint64(32 * j)) & np.uint64(0xFFFFFFFF)) / chars
    table = np.full((rows, PASSAGE), np.iinfo(np.uint64).max)
    table[row, slot] = hashes
    table = table[some]
    table.sort(axis=1)
    distinct = 1 + ((table[:, 1:] != table[:, :-1]) & (np.arange(1, PASSAGE) < n[:, None])).sum(1)
    same = np.concatenate(([False], hashes[1:] == hashes[:-1])) & (slot > 0)
    c = N_CLASSES
    out[some, c] = np.add.reduceat(same.astype(np.int64), head) / n
    out[some, c + 1] = distinct / n
    out[some, c + 2] = np.minimum(chars / n, 40) / 10
    out[some, c + 3] = np.log1p(np.maximum.reduceat(size, head)) / 5
    out[some, c + 4] = n / PASSAGE
    sign = np.where(hashes >> np.uint64(60) & np.uint64(1), 1.0, -1.0)
    bucket = (hashes % np.uint64(HASHED)).astype(np.int64)
    hashed = np.bincount(row * HASHED + bucket, sign, rows * HASHED).reshape(rows, HASHED)
    out[some, c + 5 :] = hashed[some] / np.sqrt(n)[:, None]
    return out, per


@dataclass
class AttentionModel:
    """Weights of encoder (w, b), gated attention (v, vb, u, ub, a) and head (c, c0); features are standardised."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representation and attention logit of each passage."""
        h = np.tanh(((x - self.mean) / self.scale) @ self.p["w"] + self.p["b"])
        v, u = np.tanh(h @ self.p["v"] + self.p["vb"]), _sigmoid(h @ self.p["u"] + self.p["ub"])
        return h, (v * u) @ self.p["a"]

    def score(self, x: np.ndarray, per: np.ndarray) -> np.ndarray:
        h, e = self.passages(x)
        return _sigmoid(_pool(h, _attention(e, per), per) @ self.p["c"] + self.p["c0"][0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _attention(e: np.ndarray, per: np.ndarray) -> np.ndarray:
    cuts = np.cumsum(per) - per
    w = np.exp(e - np.repeat(np.maximum.reduceat(e, cuts), per))
    return w / np.repeat(np.add.reduceat(w, cuts), per)


def _pool(h: np.ndarray, alpha: np.ndarray, per: np.ndarray) -> np.ndarray:
    return np.add.reduceat(h * alpha[:, None], np.cumsum(per) - per)


def fit(x: np.ndarray, per: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30,
        batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> AttentionModel:
    """Adam on the mean log-loss of the documents (x: passages, per: passages of each document, y: 0/1)."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    mean, scale = x.mean(0), x.std(0) + 1e-3
    p = {"w": rng.normal(0, f**-0.5, (f, hidden)), "b": np.zeros(hidden), "v": rng.normal(0, hidden**-0.5, (hidden, gate)),
         "vb": np.zeros(gate), "u": rng.normal(0, hidden**-0.5, (hidden, gate)), "ub": np.zeros(gate),
         "a": rng.normal(0, gate**-0.5, gate), "c": np.zeros(hidden),
         "c0": np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])}
    z = ((x - mean) / scale).astype(np.float64)
    start = np.cumsum(per) - per
    m, s = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            n = per[docs]
            xb = z[np.repeat(start[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            h = np.tanh(xb @ p["w"] + p["b"])
            v, u = np.tanh(h @ p["v"] + p["vb"]), _sigmoid(h @ p["u"] + p["ub"])
            alpha = _attention((v * u) @ p["a"], n)
            r = _pool(h, alpha, n)
            d = (_sigmoid(r @ p["c"] + p["c0"][0]) - y[docs]) / len(docs)
            dr = np.repeat(d[:, None] * p["c"], n, 0)
            da = (h * dr).sum(1)
            de = alpha * (da - np.repeat(np.add.reduceat(alpha * da, np.cumsum(n) - n), n))
            dg = de[:, None] * p["a"]
            dv, du = dg * u * (1 - v * v), dg * v * u * (1 - u)
            dh = (alpha[:, None] * dr + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
            grad = {"w": xb.T @ dh, "b": dh.sum(0), "v": h.T @ dv, "vb": dv.sum(0), "u": h.T @ du, "ub": du.sum(0),
                    "a": (v * u).T @ de, "c": r.T @ d, "c0": np.array([d.sum()])}
            t += 1
            for k in p:
                g = grad[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return AttentionModel(mean, scale, p)


def held_out(doc_id: Column) -> Column:
    """The fold that no fit sees: crc32 of the id as text is divisible by 5. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, n: int) -> DataFrame:
    """At most ``n`` labelled (doc_id, text, label) rows outside the held-out fold, the first by a hash of the id.

    Null ids and labels are left out; of several labels of one id the smallest counts.
    """
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    some = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(some), "doc_id")  # at most n rows


def _bags(it):
    for rb in batches(it, "text"):
        x, per = passage_features(rb.column("text").to_pylist())
        cuts = np.cumsum(per)
        yield pa.RecordBatch.from_arrays(
            [rb.column("doc_id"), rb.column("label"),
             pa.array([x[b - n : b].tobytes() for b, n in zip(cuts.tolist(), per.tolist())], pa.binary())],
            ["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> AttentionModel | None:
    """The model fitted on a bounded sample of labelled documents; None without labels."""
    rows = fit_sample(docs, labels, label, MAX_FIT_DOCS).mapInArrow(
        _bags, "doc_id long, label int, x binary").dropDuplicates().orderBy("doc_id", "x").toArrow()
    if not rows.num_rows:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows.column("x").to_pylist()]
    return fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array(rows.column("label").to_pylist(), float))


def annotate(docs: DataFrame, scorer: Callable[[list], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """``docs`` with double columns ``names`` that ``scorer`` finds from the texts; all other columns pass through."""
    def run(it):
        for rb in batches(it, "text"):
            got = scorer(rb.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*rb.columns, *(pa.array(got[n], pa.float64()) for n in names)],
                                             [*rb.schema.names, *names])
        release_memory()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def with_quality(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``docs`` with the quality score of each text in column ``name``."""
    model = train(docs, labels)
    release_memory()

    def scorer(texts):
        # equal texts score alike to the last digit wherever they stand in a batch
        return {name: np.full(len(texts), 0.5) if model is None else model.score(*passage_features(texts)).round(12)}

    return annotate(docs, scorer, [name])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Every whole text is scored, whatever its length; null and empty texts are
    one passage without words. Without any labels every score is 0.5. Rows may
    repeat and have null ids; columns other than doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_quality(docs, labels, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
