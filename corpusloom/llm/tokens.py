"""Token ids of whole texts with a public word-end tokenizer, by way of bounded caches of words.

The tokenizer lower-cases and cuts a text into pre-tokens (letters, single digits, runs of other signs; white
space goes) before it merges, so a text's ids are its words' ids joined, and a word's its pre-tokens'. Words and
pre-tokens repeat, so dictionaries from them to ids save most of the work, and Arrow finds the distinct words of
a batch of texts: Python sees each once. Words with signs that Python might lower-case or cut in another way go
to the tokenizer as they are. What is remembered is bounded.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from corpusloom.llm.words import batches

CACHE = 500_000
#: Words of these signs alone are cut here; NFC and lower-casing do the same to them in Python.
_SAFE = re.compile("[!-~À-ÿ]+")
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")
#: Pre-tokens that one call of the tokenizer gets.
_TOGETHER = 100


class WordTokenizer:
    """Ids of whole texts, as little-endian uint32 bytes; the same as ``Tokenizer.encode(..., add_special_tokens=False)``.

    Words' ids are in one array, where a full memory keeps the words that came more than once. Pre-tokens have two
    dictionaries: when the younger is full it takes the older's place, and what is used again moves up.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case ASCII pre-tokens, which neither normalizing, cutting nor the byte alphabet changes.
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Sequence([])
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.most = cache
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, int] = {}  # to their place in the arrays
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.start, self.count, self.hits = (np.zeros(0, np.int64) for _ in range(3))

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, tokenizer, pieces: list[str]) -> None:
        """Many at once: each pre-token gives one id that ends a word."""
        runs = [" ".join(pieces[i : i + _TOGETHER]) for i in range(0, len(pieces), _TOGETHER)]
        ids = np.array([i for e in tokenizer.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids], "<u4")
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(stops) == len(pieces):
            raw = ids.tobytes()
            self.pieces.update(zip(pieces, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        else:  # a piece that isn't one pre-token after all
            self.pieces.update((p, self._plain(p)) for p in pieces)

    def _learn(self, every: set[str]) -> None:
        missing = every.difference(self.pieces)
        if missing and len(self.pieces) + len(missing) > self.most:
            self.older, self.pieces = self.pieces, {}
            missing = every
        again = {p for p in missing if p in self.older}
        self.pieces.update((p, self.older[p]) for p in again)
        new = missing - again
        self._merged(self.merger, [p for p in new if p.isascii()])
        self._merged(self.tokenizer, [p for p in new if not p.isascii()])

    def _ids(self, new: list[str]) -> list[bytes]:
        """Ids of words, by their pre-tokens."""
        cut = [(w.lower(),) if w.isascii() and w.isalpha() else _CUT.findall(w.lower()) if _SAFE.fullmatch(w) and "<|" not in w else None for w in new]
        self._learn(set().union(*[c for c in cut if c]))
        get = self.pieces.__getitem__
        return [self._plain(w) if c is None else get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for w, c in zip(new, cut)]

    def _tidy(self) -> None:
        """Keep the words that came more than once, half of what there is room for at most."""
        least = 2
        while (keep := self.hits >= least).sum() > self.most // 2:
            least += 1
        count = self.count[keep]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        self.flat = self.flat[np.arange(total) + np.repeat(self.start[keep] - (ends - count), count)]
        self.start, self.count, self.hits, self.used = ends - count, count, self.hits[keep] // 2, total
        places = iter(range(len(count)))
        self.words = {w: next(places) for w, k in zip(self.words, keep.tolist()) if k}

    def _find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        return at, np.flatnonzero(at < 0)

    def _places(self, words: list[str]) -> np.ndarray:
        """Each distinct word's place in the arrays; new ones get one. A slice's own words always have room."""
        at, new = self._find(words)
        if len(new) and len(self.words) + len(new) > self.most:
            self._tidy()
            at, new = self._find(words)
        if len(new):
            missing = [words[i] for i in new.tolist()]
            made = self._ids(missing)
            count = np.fromiter(map(len, made), np.int64, len(made)) // 4
            fresh = np.frombuffer(b"".join(made), "<u4")
            if self.used + len(fresh) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(fresh), "<u4")])
            self.flat[self.used : self.used + len(fresh)] = fresh
            at[new] = np.arange(len(self.count), len(self.count) + len(new))
            self.words.update(zip(missing, at[new].tolist()))
            self.start = np.concatenate([self.start, self.used + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.hits = np.concatenate([self.hits, np.zeros(len(count), np.int64)])
            self.used += len(fresh)
        self.hits[at] += 1
        return at

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """The ids of each text; null: none."""
        out = []
        for places, words, ends in batches(column, ascii=True):
            at = self._places(words.to_numpy(zero_copy_only=False).tolist())
            start, count = self.start[at], self.count[at]
            n = count[places]
            total = np.concatenate([[0], np.cumsum(n)])
            raw = self.flat[np.arange(total[-1]) + np.repeat(start[places] - total[:-1], n)].tobytes()
            stops = (4 * total[ends]).tolist()
            out += [raw[i:j] for i, j in zip([0, *stops], stops)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker: what a task has learned serves the next."""
    return WordTokenizer(path)
