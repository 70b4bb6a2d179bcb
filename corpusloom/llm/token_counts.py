"""Edit-aware token counts.

A document is cut into pre-tokens, between which a byte-level BPE never merges, so its token count is the sum of its
pre-tokens'. A segment tree keeps the sums: a leaf is a run of up to ``LEAF`` pre-tokens with its code points and
tokens, an inner node adds up two below it. An edit touches the leaves that it overlaps. They are cut again with
the text behind them until the new cuts meet an old leaf's start, with the leaf before as context, as a
pre-token may grow backwards; only pre-tokens that are new there are encoded, and sums on the paths above change.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import arrow_map, only, table

TOKENIZER = "byte_bpe_50k.tiktoken"
LEAF = 32
CACHE = 300_000


class Counter:
    """Cuts texts into pre-tokens and counts their tokens, with a bounded memory of counts."""

    def __init__(self, path: str, pattern: str | None = None):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = pattern or public_tokenizers.PATTERN
        self.cut = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.encoded = 0

    def count(self, pieces: list[str]) -> list[int]:
        known = self.known
        missing = set(pieces).difference(known)
        if missing:
            if len(known) + len(missing) > CACHE:
                known.clear()
                missing = set(pieces)
            for p in missing:
                known[p] = len(self.encoding.encode_ordinary(p))
        return list(map(known.__getitem__, pieces))

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)


@cache
def counter(name: str) -> Counter:
    from corpusloom.llm.packing import tokenizer_path

    return Counter(tokenizer_path(name))


class CountTree:
    """A text, cut into leaves, under a segment tree of (code points, tokens)."""

    def __init__(self, text: str, counts: Counter, leaf: int = LEAF):
        self.counts, self.leaf = counts, leaf
        self.encoded_chars = 0
        self._grow(self._leaves(counts.pieces(text)))

    def _leaves(self, pieces: list[str]) -> list[tuple[str, int]]:
        """(text, tokens) of runs of pre-tokens."""
        n = self.counts.count(pieces)
        self.encoded_chars += sum(map(len, pieces))
        return [("".join(pieces[i : i + self.leaf]), sum(n[i : i + self.leaf])) for i in range(0, len(pieces), self.leaf)]

    def _grow(self, leaves: list[tuple[str, int]]) -> None:
        self.texts = [t for t, _ in leaves]
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        tree = np.zeros((2 * self.size, 2), np.int64)
        if leaves:
            tree[self.size : self.size + len(leaves)] = [(len(t), n) for t, n in leaves]
        level = self.size
        while level > 1:
            tree[level // 2 : level] = tree[level : 2 * level : 2] + tree[level + 1 : 2 * level : 2]
            level //= 2
        self.tree = tree

    @property
    def chars(self) -> int:
        return int(self.tree[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.tree[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a code point, and where the leaf starts; the last leaf for the end of the text."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if before + self.tree[node, 0] <= char:
                before += int(self.tree[node, 0])
                node += 1
        leaf = node - self.size
        if leaf >= len(self.texts):
            leaf = max(0, len(self.texts) - 1)
            before = self.chars - (len(self.texts[leaf]) if self.texts else 0)
        return leaf, before

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` for the code points from ``start`` to ``end``."""
        if not 0 <= start <= end <= self.chars:
            raise ValueError(f"no range {start}:{end} in {self.chars} code points")
        if not self.texts:
            self._grow(self._leaves(self.counts.pieces(new)))
            return
        first, at = self.find(start)
        if first:  # the leaf before is context: its last pre-token may take in what follows
            first -= 1
            at -= len(self.texts[first])
        last, last_at = self.find(end)
        stop = last + 1  # leaves first..stop-1 are cut again
        old = self.texts[first:stop]
        body = "".join(old)
        fresh = body[: start - at] + new + body[end - at :]
        while True:
            # With a leaf of the old text behind, are the cuts there as they were?
            ahead = self.texts[stop] if stop < len(self.texts) else ""
            pieces = self.counts.pieces(fresh + ahead)
            if not ahead:
                break
            sum_, k = 0, 0
            while k < len(pieces) and sum_ < len(fresh):
                sum_ += len(pieces[k])
                k += 1
            if sum_ == len(fresh) and pieces[k:] == self.counts.pieces(ahead) and len(pieces) - k > 1:
                pieces = pieces[:k]
                break
            fresh += ahead
            stop += 1
        leaves = self._leaves(pieces)
        self._replace(first, stop, leaves)

    def _replace(self, first: int, stop: int, leaves: list[tuple[str, int]]) -> None:
        if len(leaves) == stop - first:
            self.texts[first:stop] = [t for t, _ in leaves]
            nodes = set()
            for i, (t, n) in enumerate(leaves, self.size + first):
                self.tree[i] = len(t), n
                nodes.add(i // 2)
            while nodes and nodes != {0}:
                for node in nodes:
                    self.tree[node] = self.tree[2 * node] + self.tree[2 * node + 1]
                nodes = {node // 2 for node in nodes if node > 1}
            return
        kept = self.tree[self.size : self.size + len(self.texts), 1].tolist()
        before = list(zip(self.texts[:first], kept[:first]))
        after = list(zip(self.texts[stop:], kept[stop:]))
        self._grow(before + leaves + after)  # sums alone; nothing of these is encoded again


# -- operator -------------------------------------------------------------------------------------------------


def standard_edits(doc_id: int | None, text: str) -> list[tuple[int, int, str]]:
    """Three edits that a document's id and length fix, for measuring: one puts a word in, one takes a stretch out, one repeats a stretch.

    Each is (start, end, new) in code points of the text as the edits before left it.
    """
    seed = xxhash.xxh64_intdigest(str(doc_id).encode(), 13)
    n, made = len(text), []
    at = seed % (n + 1)
    made.append((at, at, f" edit{seed % 1000} "))
    n += len(made[0][2])
    start = (seed >> 16) % n
    end = min(n, start + 1 + (seed >> 8) % 40)
    made.append((start, end, ""))
    n -= end - start
    start = (seed >> 32) % (n + 1)
    end = min(n, start + 1 + (seed >> 24) % 12)
    made.append((start, end, text[: (seed >> 40) % 30]))
    return made


SCHEMA = "doc_id long, n_chars long, n_pretokens long, n_leaves long, n_tokens long, edited_chars long, edited_tokens long, recut_chars long"


def edited_counts(docs: DataFrame, tokenizer: str = TOKENIZER, edits=standard_edits, leaf: int = LEAF) -> DataFrame:
    """Token counts of every whole text before and after ``edits(doc_id, text)``, the second from the tree.

    ``recut_chars`` is how many code points were cut again for the edits. Null or empty text: no code points, no
    tokens, and edits that put text in count as any. Null doc_id: returned as null. Repeated rows: a row each.
    Other columns are ignored. No rows: no rows.
    """

    def make():
        counts = counter(tokenizer)

        def f(batch):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                tree = CountTree(text, counts, leaf)
                before, leaves, first = tree.tokens, len(tree.texts), tree.encoded_chars
                pre = len(counts.pieces(text)) if leaves <= 1 else (leaves - 1) * leaf + len(counts.pieces(tree.texts[-1]))
                for start, end, new in edits(doc, text):
                    tree.edit(start, end, new)
                rows.append((doc, len(text), pre, leaves, before, tree.chars, tree.tokens, tree.encoded_chars - first))
            return dict(zip((x.split()[0] for x in SCHEMA.split(", ")), zip(*rows)))

        return f

    return arrow_map(only(docs, "doc_id", "text"), SCHEMA, make, 256)


# -- query ----------------------------------------------------------------------------------------------------


def op1_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"))
