"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. The model of each link is
logistic regression on hashed words and word beginnings, plus the
probabilities of all earlier categories. It is trained on out-of-fold
probabilities of the earlier links, so that it meets in training what it will
meet in scoring; the models that score are fitted on all training rows.

Texts are read in passages of ``PASSAGE`` words, and the odds of a text are
the mean of its passages' odds: a long text is no likelier to be rejected for
its mere number of words, and a toxic passage counts wherever it lies (the
longer the text, the clearer a single one must be).

``labels`` may carry one 0/1 column per category. A category that has no
column is labelled weakly: toxic texts that use one of its terms.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordlens.llm.mil import annotate, held_out
from ordlens.llm.minhash import batches
from ordlens.llm.shingles import word_spans
from ordlens.llm.tokens import release_memory
from ordlens.session import materialize

#: Categories in chain order with the terms that label them weakly; the last is the label itself.
CHAIN: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("demeaning", ("idiot", "moron", "stupid", "dumb", "fool")),
    ("contempt", ("loser", "pathetic", "worthless", "clown", "useless")),
    ("dehumanising", ("scum", "trash", "disgusting", "vermin", "filth")),
    ("toxic", ()),
)
#: Words in a passage.
PASSAGE = 256
#: The fit takes at most so many labelled documents of each class, of any length and whole. If their passages are more
#: than the second number, each document gives the same share of its passages, evenly spread, and one at least.
MAX_FIT_DOCS = 4000
MAX_FIT_PASSAGES = 48_000
#: Features that a link keeps; the fewest texts that must have one, the largest share of clean texts that may, the least z score.
MAX_FEATURES = 1024
MIN_TEXTS = 3
MAX_SHARE = 0.1
MIN_Z = 3.0
FOLDS = 5
#: Beginnings of words, in bytes, that are features beside the words.
PREFIXES = (4, 5, 6)

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_HOT = 1 << 16
_RARE = 1 << 22


def features(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each passage's distinct features (hashes of its words and word beginnings, A-Z lower-cased), each text's passages.

    A text without words is one empty passage.
    """
    _, start, end, hashes, counts = word_spans(texts, _GAP, PREFIXES)
    slots = [_slot(h, i) for i, h in enumerate(hashes)]
    long = [np.ones(len(start), bool), *((end - start) > n for n in PREFIXES)]
    sets, per = [], []
    for c, e in zip(counts.tolist(), np.cumsum(counts).tolist()):
        heads = range(e - c, e, PASSAGE) or [e]
        for a in heads:
            b = min(a + PASSAGE, e)
            sets.append(np.unique(np.concatenate([s[a:b][m[a:b]] for s, m in zip(slots, long)])))
        per.append(len(heads))
    return sets, np.array(per, np.int64)


def _slot(hashes: np.ndarray, kind: int) -> np.ndarray:
    return ((hashes * np.uint64(2 * kind + 1)) >> np.uint64(1)).astype(np.int64)


def term_slots(terms: tuple[str, ...]) -> np.ndarray:
    return np.array([_slot(word_spans([t], _GAP, PREFIXES)[3][0], 0)[0] for t in terms], np.int64)


@dataclass
class Linear:
    """Logistic regression: sorted feature slots with weights, weights of earlier probabilities, bias."""

    slots: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray, slots: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """``rows``, ``slots``: the (text, feature) pairs of ``n`` texts."""
        at = np.minimum(np.searchsorted(self.slots, slots), max(len(self.slots) - 1, 0))
        hit = self.slots[at] == slots if len(self.slots) else np.zeros(len(slots), bool)
        return np.bincount(rows[hit], self.weights[at[hit]], n) + earlier @ self.chain + self.bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _pairs(sets: list[np.ndarray], able: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, new number) of all features that are ``able``."""
    kept = [number[x[able[x]]] for x in sets]
    return np.repeat(np.arange(len(kept), dtype=np.int32), [len(x) for x in kept]), np.concatenate(kept)


def _frequent(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets without what is rare even with others in its slot, which is most of them."""
    count = np.zeros(_RARE, np.int32)
    for x in sets:
        count[x % _RARE] += 1
    return [x[count[x % _RARE] >= MIN_TEXTS].astype(np.int64) for x in sets]


class Sample:
    """The (passage, feature) pairs of a fit's texts; features are numbered in the order of ``names``."""

    def __init__(self, sets: list[np.ndarray], text: np.ndarray, clean: np.ndarray):
        """``text``: each passage's text; ``clean``: whether a text is in no category. Rare and common features go."""
        self.text, self.n = text, len(sets)
        sets = _frequent(sets)
        names = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
        sets = [np.searchsorted(names, x).astype(np.int32) for x in sets]
        cuts = np.flatnonzero(np.diff(text, prepend=-1)).tolist()
        once = [sets[i] if j - i == 1 else np.unique(np.concatenate(sets[i:j])) for i, j in zip(cuts, [*cuts[1:], self.n])]
        seen, usual = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32)
        for x, ok in zip(once, clean):  # a feature counts once a text
            seen[x] += 1
            usual[x] += ok
        able = (seen >= MIN_TEXTS) & (usual <= MAX_SHARE * clean.sum() + 1)
        number = (np.cumsum(able) - 1).astype(np.int32)
        self.names = names[able]
        self.rows, self.slots = _pairs(sets, able, number)
        self.texts, self.features = _pairs(once, able, number)

    def logits(self, link: Linear, earlier: np.ndarray) -> np.ndarray:
        """Of all passages, by a link of ``fit``."""
        known = np.zeros(len(self.names), bool)
        known[link.slots] = True
        hit = known[self.slots]
        return link.logits(self.rows[hit], self.slots[hit], self.n, earlier)

    def fit(self, earlier: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 150, decay: float = 2e-3) -> Linear:
        """Weighted logistic regression on the features that speak most surely for the class (log odds over their error).

        ``y``, ``w`` are the texts'. All passages of a text outside the class
        count against it; of one inside, the passage with most evidence counts
        for it and the others not at all.
        """
        pos = y > 0
        prior = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-6, 1 - 1e-6)
        bias = float(np.log(prior / (1 - prior)))
        if not pos.any() or pos.all():
            return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), bias)
        p, q = (pos & (w > 0)).sum(), (~pos & (w > 0)).sum()
        a, b = (np.bincount(self.features[m], minlength=len(self.names)) + 0.5 for m in (
            (pos & (w > 0))[self.texts], (~pos & (w > 0))[self.texts]))
        z = (np.log(a / (p + 1 - a)) - np.log(b / (q + 1 - b))) / np.sqrt(1 / a + 1 / b)
        able = np.flatnonzero((a + b >= MIN_TEXTS + 1) & (z >= MIN_Z))
        keep = np.sort(able[np.argsort(-z[able], kind="stable")[:MAX_FEATURES]])
        k = len(keep)
        place = np.full(len(self.names), -1, np.int32)
        place[keep] = np.arange(k)
        hit = (place >= 0)[self.slots]
        r, c = self.rows[hit], place[self.slots[hit]]
        best = np.lexsort((-np.bincount(r, z[keep][c], self.n), self.text))
        used = ~pos[self.text]
        used[best[np.unique(self.text[best], return_index=True)[1]]] = True
        y, w = y[self.text], w[self.text] * used
        w = w / max(w.sum(), 1e-9)
        theta = np.zeros(k + earlier.shape[1] + 1)
        theta[-1] = bias
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, steps + 1):
            logit = np.bincount(r, theta[c], self.n) + earlier @ theta[k:-1] + theta[-1]
            d = w * (_sigmoid(logit) - y)
            g = np.concatenate((np.bincount(c, d[r], k), earlier.T @ d, [d.sum()])) + decay * np.append(theta[:-1], 0) / 100
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        return Linear(keep, theta[:k], theta[k:-1], float(theta[-1]))


@dataclass
class Chain:
    """The links in order, and the cut on the last probability."""

    names: list[str]
    links: list[Linear] = field(default_factory=list)
    cut: float = 0.5

    def predict(self, sets: list[np.ndarray]) -> np.ndarray:
        """Probabilities (passage, category)."""
        hot = np.zeros(_HOT, bool)
        for link in self.links:
            hot[link.slots % _HOT] = True
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        slots = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
        near = hot[slots % _HOT]
        rows, slots = rows[near], slots[near]
        out = np.zeros((len(sets), len(self.links)))
        for i, link in enumerate(self.links):
            out[:, i] = _sigmoid(link.logits(rows, slots, len(sets), out[:, :i]))
        return out


    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities (text, category)."""
        sets, per = features(texts)
        return pooled(self.predict(sets), per) if len(per) else np.zeros((0, len(self.links)))


def pooled(p: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Each text's probability from those of its ``per`` passages: the odds are the mean of theirs.

    If any one passage may be the toxic one, this is Bayes' rule: a text's
    likelihood ratio is the mean of its passages' ratios.
    """
    p = np.clip(p, 1e-12, 1 - 1e-12)
    odds = (np.add.reduceat(p / (1 - p), np.cumsum(per) - per).T / per).T
    return odds / (1 + odds)


def fit_chain(ids: list[int], sets: list[np.ndarray], targets: dict[str, np.ndarray], weight: np.ndarray,
              per: np.ndarray | None = None) -> Chain:
    """Links in the order of ``targets``; folds are dealt by a checksum of the id.

    ``sets`` are the passages' features, ``per`` each text's number of passages (one, if not given).
    """
    per = np.ones(len(ids), np.int64) if per is None else per
    text = np.repeat(np.arange(len(per)), per)
    data = Sample(sets, text, ~np.any([y > 0 for y in targets.values()], axis=0))
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in ids])
    out, chain = np.zeros((len(sets), 0)), Chain(list(targets))
    for y in targets.values():
        full = data.fit(out, y, weight)
        oof = np.zeros(len(sets))
        for k in range(FOLDS):
            test = fold == k
            if test.any():
                link = data.fit(out, y, np.where(test, 0.0, weight)) if not test.all() else full
                oof[test[text]] = _sigmoid(data.logits(link, out))[test[text]]
        chain.links.append(Linear(data.names[full.slots], full.weights, full.chain, full.bias))
        out = np.column_stack((out, oof))
    chain.cut = best_cut(pooled(out[:, -1], per), y, weight)
    return chain


def best_cut(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The middle of the widest gap among the cuts of the best weighted F1 (0.5 if one class is missing)."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    tp, all_ = np.cumsum((w * y)[order]), np.cumsum(w[order])
    f1 = 2 * tp / (all_ + (w * y).sum())
    last = np.append(p[order][1:] < p[order][:-1], True)
    f1[~last] = -1
    i = int(np.argmax(f1))
    low = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + low) / 2)


def _passages(weak: list[tuple[str, ...]]):
    """Rows of passages: (doc_id, targets, weight, digest, n, at, found, x), ``found`` saying which ``weak`` terms the whole text has."""
    def run(it):
        terms = [term_slots(t) for t in weak]
        for rb in batches(it, "text"):
            texts = rb.column("text").to_pylist()
            sets, per = features(texts)
            first = np.cumsum(per) - per
            row = pa.array(np.repeat(np.arange(len(per)), per))
            at = np.arange(len(sets)) - np.repeat(first, per)
            digest = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            found = [np.maximum.reduceat([np.isin(t, s).any() for s in sets], first).astype(np.int32) for t in terms]
            found = [list(f) for f in zip(*(f.tolist() for f in found))] if terms else [[]] * len(per)
            cols = [rb.column("doc_id"), rb.column("targets"), rb.column("weight"), pa.array(digest, pa.string()), pa.array(per)]
            yield pa.RecordBatch.from_arrays(
                [*(c.take(row) for c in cols), pa.array(at, pa.int64()), pa.array(found, pa.list_(pa.int32())).take(row),
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "targets", "weight", "digest", "n", "at", "found", "x"])
        release_memory()

    return run


def thinned(rows: DataFrame, side: str, most: int) -> DataFrame:
    """Passages (``n`` of a text, numbered ``at`` from 0) as they are, or an even share of each text's where a side has over ``most``."""
    share = rows.groupBy(side).agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count(F.lit(1))).alias("_share"))  # two rows
    taken = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * F.col("_share")))
    return rows.join(F.broadcast(share), side).where(
        F.floor((F.col("at") + 1) * taken / F.col("n")) > F.floor(F.col("at") * taken / F.col("n"))).drop("_share")


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN) -> Chain:
    """The chain fitted on at most ``MAX_FIT_DOCS`` documents of each class outside the held-out fold.

    Rows are weighted back to the classes' true shares. Passages beyond
    ``MAX_FIT_PASSAGES`` of a class are thinned evenly; weak labels come from
    whole texts all the same.
    """
    names = [c for c, _ in chain]
    given = [c for c in names if c in labels.columns]
    weak = [(c, t) for c, t in chain if c not in given]
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(names[-1]).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c).cast("int").alias(c) for c in given])
    sizes = {r[0]: r[1] for r in lab.groupBy(F.col(names[-1]) > 0).count().collect()}
    parts = [lab.where((F.col(names[-1]) > 0) == side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_FIT_DOCS).withColumn(
        "weight", F.lit(max(sizes.get(side, 0) / MAX_FIT_DOCS, 1.0))) for side in (True, False)]
    some = parts[0].union(parts[1]).select("doc_id", F.array(*given).alias("targets"), "weight")
    passages = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(some), "doc_id").mapInArrow(  # at most 2 x MAX_FIT_DOCS rows
        _passages([t for _, t in weak]), "doc_id long, targets array<int>, weight double, digest string, n long, at long, "
        "found array<int>, x binary").dropDuplicates(["doc_id", "digest", "at"])
    passages = materialize(passages.withColumn("side", F.col("targets")[len(given) - 1] > 0), "chain-passages")
    rows = thinned(passages, "side", MAX_FIT_PASSAGES).orderBy("doc_id", "digest", "at").toArrow()
    if not rows.num_rows:
        return Chain(names, [Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(i), -10.0) for i in range(len(names))])
    ids, digests = (np.array(rows.column(c).to_pylist()) for c in ("doc_id", "digest"))
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])))
    per = np.diff(np.append(first, len(ids)))
    sets = [np.frombuffer(x.as_buffer(), np.int64) for b in rows.column("x").chunks for x in b]
    head = rows.select(["targets", "found", "weight"]).take(pa.array(first))
    got, found = (np.array(head.column(c).to_pylist(), float) for c in ("targets", "found"))
    toxic = (got[:, given.index(names[-1])] > 0).astype(float)
    columns = {c: (np.nan_to_num(got[:, i]) > 0).astype(float) for i, c in enumerate(given)} | {
        c: toxic * found[:, i] for i, (c, _) in enumerate(weak)}
    targets = {c: columns[c] for c in names}
    ids, weight = ids[first].tolist(), np.array(head.column("weight").to_pylist(), float)
    sets = _frequent(sets)  # the driver holds the gathered rows no longer than it must
    del rows, head, digests
    release_memory()
    return fit_chain(ids, sets, targets, weight, per)


def with_toxicity(docs: DataFrame, labels: DataFrame, names: list[str], chain=CHAIN) -> tuple[DataFrame, float]:
    """``docs`` with the chain's probabilities in columns ``names``, and the cut on the last."""
    model = train(docs, labels, chain)
    release_memory()

    def scorer(texts):
        return dict(zip(names, model.of_texts(texts).T))

    return annotate(docs, scorer, names), model.cut


def toxicity_scores(docs: DataFrame, labels: DataFrame, chain=CHAIN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, a probability per category, rejected, kept.

    Every whole text is scored, passage by passage. ``rejected`` is true from the cut on that does
    best on out-of-fold probabilities (weighted F1). Null and empty texts have
    no features and get the chain's base rate; without labels nothing is
    rejected. Rows may repeat and have null ids; other columns are ignored.
    """
    names = [f"p_{n}" for n, _ in chain]
    scored, cut = with_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, names, chain)
    bad = F.col(names[-1]) >= F.lit(cut)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names, bad.alias("rejected"),
                         (~bad).alias("kept"))
