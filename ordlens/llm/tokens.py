"""Encoding texts word by word with a word-level BPE file of the tokenizers library.

The tokenizer drops white space and never merges across it, so a text's ids
are those of its white-space words in order. A word is encoded by the file's
own normaliser and BPE model; words with characters outside ASCII and the
Latin blocks, or with a special token, go through the whole tokenizer.
"""

from __future__ import annotations

import ctypes
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept per Python worker; beyond that the cache starts anew.
CACHE = 300_000
_ENCODERS: dict[str, WordEncoder] = {}


def _byte_chars() -> dict[int, int]:
    """The character that byte-level BPE files use for each byte: itself if printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Pool:
    """Keys with a run of ids each: a key's place, and the runs joined in one array."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, keys: list[str], ids, counts: np.ndarray) -> None:
        at = len(self.place)
        while at + len(keys) > len(self.start):
            self.start, self.count = (np.concatenate((a, np.zeros_like(a))) for a in (self.start, self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.count[at : at + len(keys)] = counts
        self.start[at : at + len(keys)] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(keys, range(at, at + len(keys))))

    def at(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the keys at these places, joined."""
        return self.ids[ragged(self.start[at], self.count[at])]


class WordEncoder:
    """ids of words, with a bounded cache."""

    def __init__(self, path: str, cache: int | None = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.limit = cache
        split = self.whole_split(path)
        self.find = regex.compile(split).findall
        self.plain = re.compile("[\x21-\x7e\xa1-ſ]+").fullmatch
        specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)").search
        self.mark = specials[0][0] if len({t[0] for t in specials}) == 1 else ""  # only words with it may hold a special token
        self.tokenize = self.whole.model.tokenize
        self.clear()

    @staticmethod
    def whole_split(path: str) -> str:
        """The pattern by which the file cuts words into units."""
        import json

        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        return next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")

    def clear(self) -> None:
        self.words, self.units = Pool(), Pool()

    def _learn(self, words: list[str]) -> None:
        plain, special, mark = self.plain, self.special, self.mark
        easy = [w for w in words if plain(w) and not (mark in w and special(w))]
        if easy:
            # one pass of the file's normaliser over all of them; it neither makes nor drops a space between them
            cut = list(map(self.find, self.whole.normalizer.normalize_str(" ".join(easy)).split(" ")))
            flat = list(chain.from_iterable(cut))
            new = list(set(flat).difference(self.units.place))
            tokenize = self.tokenize
            ids = [[t.id for t in tokenize(u if u.isascii() else u.encode().decode("latin-1").translate(_BYTE_CHARS))] for u in new]
            self.units.add(new, list(chain.from_iterable(ids)), np.fromiter(map(len, ids), np.int64, len(ids)))
            at = self.units.at(flat)
            ends = np.cumsum(np.concatenate(([0], self.units.count[at])))[np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))]
            self.words.add(easy, self.units.gather(at), np.diff(ends, prepend=0))
        if len(easy) < len(words):
            rest = list(set(words).difference(easy))
            ids = [self.whole.encode(w, add_special_tokens=False).ids if w else [] for w in rest]
            self.words.add(rest, list(chain.from_iterable(ids)), np.fromiter(map(len, ids), np.int64, len(ids)))

    def places(self, words: list[str]) -> np.ndarray:
        """The cache place of each of the distinct ``words``, encoding those not seen yet."""
        place = self.words.place
        missing = [w for w in words if w not in place]
        if self.limit and len(place) + len(missing) > self.limit:
            # a new cache of those that came back, so are probably common
            known = [w for w in words if w in place]
            at, old = self.words.at(known), self.words
            self.words = Pool()
            self.words.add(known, old.gather(at), old.count[at])
        if missing:
            self._learn(missing)
        if self.limit and len(self.units.place) > self.limit // 2:
            self.units = Pool()
        return self.words.at(words)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), and the offset at which each text's begin (one more at the end)."""
        offsets, codes, words = split_words(texts)
        at = self.places(words)[codes]
        bounds = np.concatenate(([0], np.cumsum(self.words.count[at])))[offsets]
        return self.words.gather(at), bounds


def release_memory() -> None:
    """Hand what a finished task has freed back to the system: a worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to hand back by hand
        pass


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices start[0] .. start[0]+count[0]-1, start[1] .., joined."""
    total = np.cumsum(count)
    return np.repeat(start - (total - count), count) + np.arange(total[-1] if len(total) else 0)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """White-space words of texts: list offsets, a code per word, and the distinct words by code.

    Only ASCII white space splits here; the encoder handles the rest.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()
