"""Packing into fixed-length sequences by patterns that non-negative least squares fits to the length histogram.

The driver sees a histogram alone (a count for each length, ``seq_len`` at most). Few-document patterns of coarse
length bins that fill a sequence are enumerated, their repeat counts are fitted by non-negative least squares,
rounded down and dealt exact lengths; what stays is packed best-fit, longest first, into the gaps that the
patterns leave and then into new sequences. The result is a plan - how often each tuple of exact lengths is
used - whose size depends on the number of lengths, not of documents. Pieces then get their place by their rank
among the pieces of their length, which is counted in parts of about ``SALT_ROWS``, so no length is sorted in one task.
"""

from __future__ import annotations

import zlib
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, only, table, written

SEQ_LEN = 4096
EOS = 1
TOKENIZER = "word_bpe_49k.json"
BINS = 64
PATTERN_DOCS = 4
SALT_ROWS = 500
#: Shares of the fitted repeat counts that are tried.
SHARES = (1.0, 0.9, 0.75, 0.5)

# -- pieces ---------------------------------------------------------------------------------------------------


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare name stands for a file of the public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, eos: int = EOS, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian uint32 bytes) of each document's pieces."""

    def make():
        from corpusloom.llm.tokens import word_tokenizer

        words = word_tokenizer(tokenizer_path(tokenizer))
        end = np.array([eos], "<u4").tobytes()
        step = 4 * seq_len

        def f(batch):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            kept = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode_column(batch.column("text"))):
                ids += end
                for n, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    for k, v in zip(out, (doc, n, at // 4, len(cut) // 4, zlib.crc32(cut))):
                        out[k].append(v)
                    if keep_ids:
                        kept.append(cut)
            return out | {"ids": kept}

        return f

    return arrow_map(only(docs, "doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids, make, 2048)


# -- plan -----------------------------------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least squared error of a @ x - b, by Lawson and Hanson's active sets."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        if not len(w) or w.max() <= tol:
            break
        active[int(w.argmax())] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


@cache
def patterns(bins: int = BINS, most: int = PATTERN_DOCS) -> tuple[tuple[int, ...], ...]:
    """Tuples of 2 to ``most`` bin numbers, largest first, whose upper ends fill a sequence exactly."""
    found = []
    for n in range(2, most + 1):
        for head in combinations_with_replacement(range(1, bins), n - 1):
            last = bins - sum(head)
            if last >= head[-1]:
                found.append((last, *reversed(head)))
    return tuple(found)


def plan(hist: dict[int, int], seq_len: int = SEQ_LEN, bins: int = BINS, most: int = PATTERN_DOCS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count): how many sequences hold documents of just these lengths. Uses each length as often as ``hist`` has it.

    The fewer of the fitted counts are used, the more pieces are left to fill the patterns' gaps: the best of ``SHARES`` stays.
    """
    return min((_plan(hist, seq_len, bins, most, share) for share in SHARES), key=lambda made: sum(c for _, c in made))


def _plan(hist: dict[int, int], seq_len: int, bins: int, most: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(seq_len + 1, np.int64)
    for n, c in hist.items():
        left[n] += c
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(seq_len + 1)]  # by gap
    some = np.zeros(seq_len + 1, bool)

    def put(lengths: tuple[int, ...], count: int) -> None:
        gap = seq_len - sum(lengths)
        open_[gap][lengths] = open_[gap].get(lengths, 0) + count
        some[gap] = True

    if left[seq_len]:
        put((seq_len,), int(left[seq_len]))
        left[seq_len] = 0
    if seq_len % bins == 0 and left.any():
        width = seq_len // bins
        have = left[1:].reshape(bins, width).sum(axis=1).astype(float)
        of = patterns(bins, most)
        a = np.zeros((bins, len(of)))
        for k, p in enumerate(of):
            for b in p:
                a[b - 1, k] += 1
        weight = 1 / np.sqrt(np.maximum(have, 1))
        fitted = np.floor(nnls(a * weight[:, None], have * weight) * share + 1e-9).astype(np.int64)
        for k in sorted(np.flatnonzero(fitted), key=lambda k: of[k], reverse=True):
            todo = int(fitted[k])
            while todo:
                # The longest left of each bin, and last the longest that still fits: mostly it leaves no gap.
                used: dict[int, int] = {}
                for n, b in enumerate(of[k], 1):
                    low, high = ((b - 1) * width + 1, b * width) if n < len(of[k]) else (1, seq_len - sum(x * c for x, c in used.items()))
                    free = left[low : high + 1] > 0
                    for x, c in used.items():
                        if low <= x <= high:
                            free[x - low] = left[x] > c
                    if not free.any():
                        break
                    x = high - int(free[::-1].argmax())
                    used[x] = used.get(x, 0) + 1
                else:
                    n = min(todo, *(int(left[x]) // c for x, c in used.items()))
                    for x, c in used.items():
                        left[x] -= n * c
                    put(tuple(sorted((x for x, c in used.items() for _ in range(c)), reverse=True)), n)
                    todo -= n
                    continue
                break
    for n in range(seq_len, 0, -1):
        while left[n]:
            gap = n + int(some[n:].argmax())
            if some[gap]:
                lengths, count = next(iter(open_[gap].items()))
                used = min(count, int(left[n]))
                if used == count:
                    del open_[gap][lengths]
                    some[gap] = bool(open_[gap])
                else:
                    open_[gap][lengths] = count - used
                put((*lengths, n), used)
                left[n] -= used
            else:
                each = min(seq_len // n, int(left[n]))
                used = int(left[n]) // each
                put((n,) * each, used)
                left[n] -= each * used
    return sorted((x for by in open_ for x in by.items()), reverse=True)


def slots(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Columns length, first rank, first sequence, offset; sorted. Ranks of a length run on from slot to slot."""
    rows, used, sequence = [], {}, 0
    for lengths, count in made:
        at = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, at))
            used[n] = used.get(n, 0) + count
            at += n
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, seq_len: int = SEQ_LEN, eos: int = EOS, keep_ids: bool = False, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Every document's pieces with the sequence and the place that each has in it.

    A document is its ids, then ``eos``; longer ones than ``seq_len`` are cut into pieces of that length (the
    last may be shorter). Sequences have no gap before their last piece's end. Null or empty text: ``eos`` alone.
    Null doc_id: packed, and returned with a null id. Repeated rows: each is packed. Other columns are ignored.
    No rows: no rows. The plan is the same for the same lengths; which of equally long pieces goes where follows
    a hash of (doc_id, piece).
    """
    cut = written(pieces(docs, tokenizer, seq_len, eos, keep_ids), "packing-pieces")
    hist = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # seq_len rows at most
    place = slots(plan(hist, seq_len))
    parts = docs.sparkSession.createDataFrame([(n, -(-c // salt_rows)) for n, c in hist.items()], "length long, __parts long")  # a row a length
    salted = cut.join(F.broadcast(parts), "length").withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__parts"))).drop("__parts")
    ahead = salted.groupBy("length", "__salt").count()
    ahead = ahead.withColumn("__ahead", F.sum("count").over(W.partitionBy("length").orderBy("__salt")) - F.col("count")).select("length", "__salt", "__ahead")
    own = F.row_number().over(W.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("__n", own).join(ahead, ["length", "__salt"]).withColumn("__rank", F.col("__ahead") + F.col("__n") - 1)
    ranked = ranked.select(*cut.columns, "__rank")
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def make():
        at = sent.value
        keys = at[:, 0] << 40 | at[:, 1]

        def f(batch):
            n, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "__rank"))
            k = np.searchsorted(keys, n << 40 | rank, side="right") - 1
            own = {c: batch.column(c) for c in batch.schema.names if c != "__rank"}
            return own | {"sequence_id": pa.array(at[k, 2] + rank - at[k, 1]), "offset": pa.array(at[k, 3])}

        return f

    from pyspark.sql import types as T

    return arrow_map(ranked, T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]), make, 10_000)


# -- query ----------------------------------------------------------------------------------------------------


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
