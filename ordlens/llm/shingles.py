"""Vectorised word-shingle hashing on UTF-8 bytes.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``; A-Z are
lower-cased. A word hash is a position-free polynomial over a random byte
table (prefix sums times the inverse power), a shingle hash mixes ``k``
consecutive word hashes; both are 64 bits wide. Hash sets stand for shingle
sets: two different shingles of one comparison share a hash with probability
about set_size^2 / 2^64.
"""

from __future__ import annotations

import numpy as np

_SEED = 20240229
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20


def _byte_table() -> np.ndarray:
    t = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    t[65:91] = t[97:123]
    return t


_TABLE = _byte_table()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULT = np.random.default_rng(_SEED + 1).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _PIECE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _spans(b: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of bytes that are no gap."""
    edge = np.diff(np.concatenate(([0], (~gap[b]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash(b: np.ndarray, start: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the byte runs from ``start`` to each of ``ends``."""
    up, down = _powers(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[b] * up[: len(b)], dtype=np.uint64)))
    return [mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)) for end in ends]


def _pieces(texts: list[str | None], gap: np.ndarray):
    """The texts' bytes, a space between them, and cuts at gaps about every 1 MiB."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.concatenate(([0], np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))))
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    cuts = [0]
    while cuts[-1] < len(joined):
        to = cuts[-1] + _PIECE
        while to < len(joined) and not (found := np.flatnonzero(gap[joined[to - 1 : to + _PIECE]])).size:
            to += _PIECE
        cuts.append(len(joined) if to >= len(joined) else to + int(found[0]))
    return joined, bounds, list(zip(cuts, cuts[1:]))


def word_spans(texts: list[str | None], gap: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()):
    """All words of the texts: (bytes, start, end, hashes, words of each text).

    Hashes are taken over pieces of about 1 MiB cut at gaps, so memory follows
    the longest word, not the longest text. With ``prefixes`` the fourth item
    is a list: the words' hashes, then those of their first n bytes for each n.
    """
    joined, bounds, pieces = _pieces(texts, gap)
    starts, ends, hashes = [], [], []
    for a, b in pieces:
        start, end = _spans(joined[a:b], gap)
        if len(start):
            starts.append(start + a)
            ends.append(end + a)
            hashes.append(_hash(joined[a:b], start, [end, *(np.minimum(start + n, end) for n in prefixes)]))
    none = np.zeros(0, np.int64)
    start, end = (np.concatenate(x) if x else none for x in (starts, ends))
    all_ = [np.concatenate(h) for h in zip(*hashes)] if hashes else [np.zeros(0, np.uint64)] * (1 + len(prefixes))
    counts = np.diff(np.searchsorted(start, bounds))
    return joined, start, end, all_ if prefixes else all_[0], counts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and each text's number of words."""
    _, _, _, hashes, counts = word_spans(texts)
    return hashes, counts


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text its sorted distinct ``k``-word shingle hashes.

    Fewer than ``k`` words (but one at least): the whole sequence is the one
    shingle. No words: the empty set.
    """
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = max(len(words) - k + 1, 0)
    full = np.zeros(n, np.uint64)
    for j in range(k):
        full += words[j : j + n] * _MULT[j]
    full = mix(full)
    out = []
    for c, e in zip(counts.tolist(), ends.tolist()):
        if c >= k:
            out.append(np.unique(full[e - c : e - k + 1]))
        elif c:
            out.append(mix((words[e - c : e] * _MULT[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
