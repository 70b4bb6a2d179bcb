"""Document fingerprints by winnowing.

Every k-gram of code points has a rolling hash; of each window of ``window`` neighbouring hashes the least is
selected, the rightmost of equal ones, and its position is kept. So any passage of ``window + k - 1`` code points
that two texts share selects at least one hash that both have (``match_guarantee``).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import NULL_ID, arrow_map, only, table

K = 16
WINDOW = 32
BLOCK = 1 << 20
BUCKET_BYTES = 8 << 20
#: Ranges of doc_id at most: what the driver holds and sends. Beyond ``MAX_RANGES * BUCKET_BYTES`` of text ranges grow, and their sort spills.
MAX_RANGES = 16_384
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64(0xFFFFFFFF)


def match_guarantee(k: int = K, window: int = WINDOW) -> int:
    return window + k - 1


def _rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-gram: a polynomial mod 2^64 of its code points, by doubling, then mixed; its upper 32 bits."""
    with np.errstate(over="ignore"):
        power, base, h, out, done = 1, _BASE, codes + np.uint64(1), None, 0
        while True:
            if k & power:
                m = len(h) if out is None else len(codes) - done - power + 1
                out = h if out is None else out[:m] * np.uint64(base) + h[done : done + m]
                done += power
            if power * 2 > k:
                break
            h = h[:-power] * np.uint64(base) + h[power:]
            base, power = base * base % 2**64, power * 2
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return out >> np.uint64(32)


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    span = 1
    while span * 2 <= window:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (window - span)], keys[window - span :]) if window > span else keys


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that are selected, by position.

    A text shorter than ``k`` has one gram, all of it; one with fewer than ``window`` grams is one window; the
    empty text selects nothing. Long texts are done in blocks, with the same result.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, len(codes))
    grams = len(codes) - k + 1
    window = min(window, grams)
    found = []
    for at in range(0, grams - window + 1, BLOCK):
        stop = min(at + BLOCK, grams - window + 1) + window - 1
        hashes = _rolling(codes[at : stop + k - 1].astype(np.uint64), k)
        # Equal hashes: the later position makes the lesser key.
        least = _least(hashes << np.uint64(32) | (_LOW - np.arange(at, stop, dtype=np.uint64)), window)
        found.append(least[np.concatenate([[True], least[1:] != least[:-1]])])
    keys = np.concatenate(found)
    if len(found) > 1:
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> np.uint64(32)).astype(np.uint32), (_LOW - (keys & _LOW)).astype(np.int64)


def written_out(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Base64 of five bytes for each selected hash: the hash (big-endian) and the step from the position before (``window`` at most)."""
    out = np.zeros(len(hashes), [("h", ">u4"), ("d", "u1")])
    out["h"], out["d"] = hashes, np.diff(positions, prepend=0)
    return base64.b64encode(out.tobytes()).decode()


def read_in(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(fingerprint), [("h", ">u4"), ("d", "u1")])
    return raw["h"].astype(np.uint32), np.cumsum(raw["d"], dtype=np.int64)


def likeness(a: set, b: set) -> float:
    """Shared hashes over all hashes of two fingerprints; two empty ones are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes, positions of each whole text. Null text: empty, nothing selected. Repeated rows: a row each."""

    def make():
        def f(batch):
            made = [winnow(t or "", k, window) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "hashes": [h.tolist() for h, _ in made], "positions": [p.tolist() for _, p in made]}

        return f

    return arrow_map(only(docs, "doc_id", "text"), "doc_id long, hashes array<long>, positions array<long>", make, 256)


# -- each document beside the next ----------------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _range_of(bounds: np.ndarray, shares: np.ndarray, ids: np.ndarray, ties: list[str]) -> np.ndarray:
    """The range of each (id, digest). A bound that stands for several quantiles is an id of many rows: its digests make as many ranges."""
    at = np.searchsorted(bounds, ids)
    first = np.concatenate([[0], np.cumsum(shares)])[at]
    inner = np.flatnonzero(at < len(bounds))
    for i in inner[(shares[at[inner]] > 1) & (bounds[at[inner]] == ids[inner])].tolist():
        first[i] += int(ties[i][:8], 16) * int(shares[at[i]]) >> 32
    return first


def beside_next(docs: DataFrame, columns: str, make, bucket_bytes: int = BUCKET_BYTES, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Rows of ``make()(text, state, next text, next state)`` for each document and the next by descending doc_id.

    Documents are dealt by ranges of doc_id whose bounds are quantiles, ``max_ranges`` at most; rows of one id that
    fill several ranges (rows without ids, say) are dealt by their text's digest. The first document of each range also
    goes to the range before it (the very first to the last range), so the text moves once and no task sees all
    rows, but for repeated rows, which are of one range. ``make`` gives (state of a text, row of a pair); a state is made once for each text of a range.
    """
    spark = docs.sparkSession
    own = only(docs, "doc_id", "text")
    ids = own.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.octet_length("text").alias("b"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    total = ids.agg(F.sum("b")).first()[0] or 0
    n = min(max_ranges, max(1, -(-total // bucket_bytes)))
    cuts = ids.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []  # n values
    bounds, shares = np.unique(np.array(cuts, np.float64).astype(np.int64), return_counts=True)
    many = bool((shares > 1).any())  # else no text is read for its digest here

    def heads_of():
        return lambda batch: {"bucket": pa.array(_range_of(bounds, shares, batch.column("id").to_numpy(), batch.column("tie").to_pylist())), "id": batch.column("id"), "tie": batch.column("tie")}

    tied = ids.select("id", "tie" if many else F.lit("0").alias("tie"))
    firsts = arrow_map(tied, "bucket long, id long, tie string", heads_of, 10_000).groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("first")).collect()  # a row a range
    heads = {r["bucket"]: tuple(r["first"]) for r in firsts}
    order = sorted(heads)
    guests = {heads[b]: after for b, after in zip(order, [*order[1:], *order[:1]])}
    sent = spark.sparkContext.broadcast((bounds, shares, guests))

    def deal():
        squeeze = zstandard.ZstdCompressor(level=1).compress
        bounds, shares, guests = sent.value

        def f(batch):
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            ties = [hashlib.md5(raw, usedforsecurity=False).hexdigest() for raw in raws]
            doc_ids = batch.column("doc_id").to_pylist()
            keys = [NULL_ID if doc is None else doc for doc in doc_ids]
            out = {"bucket": [], "guest": [], "id": [], "tie": [], "z": [], "null": []}
            for bucket, key, tie, raw, doc in zip(_range_of(bounds, shares, np.array(keys, np.int64), ties).tolist(), keys, ties, raws, doc_ids):
                row = (key, tie, squeeze(raw), doc is None)
                to = [(bucket, False)]
                if (head := (key, tie if many else "0")) in guests:
                    to.append((guests[head], True))
                for to_bucket, guest in to:
                    for c, v in zip(out, (to_bucket, guest, *row)):
                        out[c].append(v)
            return out

        return f

    dealt = arrow_map(own, "bucket long, guest boolean, id long, tie string, z binary, null boolean", deal, 256)
    dealt = dealt.repartition(max(1, n), "bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), F.desc("tie"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL("doc_id long, " + columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(fields)
        expand = zstandard.ZstdDecompressor().decompress
        state_of, row_of = make()
        last = None  # (bucket, id or None, text, state), not a guest
        rows = []
        for batch in batches:
            for bucket, guest, doc, z, null in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)]):
                if guest and (last is None or last[0] != bucket):
                    continue  # another of the same id, after the first
                text = expand(z).decode("utf-8", "surrogatepass")
                state = state_of(text)
                if last is not None and last[0] == bucket:
                    rows.append((last[1], *row_of(last[2], last[3], text, state)))
                last = None if guest else (bucket, None if null else doc, text, state)
                if len(rows) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), out_schema)], schema=out_schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows), out_schema)], schema=out_schema)

    return dealt.mapInArrow(run, fields)


def edit_stability(docs: DataFrame, k: int = K, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The fingerprint of each whole text and of its edited text, and how like they are to each other and to the next document's.

    The edited text ends in the start of the next document by descending doc_id. Null text: empty. Null doc_id:
    after all others, returned as null. Rows of equal doc_id: by their text's digest, repeated rows in any order.
    One document: it is its own next. Other columns are ignored. No rows: no rows.
    """

    def make():
        def state_of(text):
            made = winnow(text, k, window)
            return made, set(made[0].tolist())

        def row_of(text, state, following, following_state):
            changed = edited(text, following)
            made, hashes = state_of(changed) if changed != text else state
            return (
                len(text),
                hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                written_out(*state[0]),
                written_out(*made),
                likeness(state[1], hashes),
                likeness(state[1], following_state[1]),
            )

        return state_of, row_of

    return beside_next(docs, "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", make, bucket_bytes)


# -- query ----------------------------------------------------------------------------------------------------


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_stability(table(spark, sf_dir, "documents"))
