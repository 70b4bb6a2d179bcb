"""Line dedup by a sharded minimal perfect hash.

Lines that many documents share are dropped from all of them but one. The distinct keys of the lines are counted (a
partial aggregate on the 128-bit hash) and become shards of a minimal perfect hash, each of which indexes compact
arrays: fingerprint (64 bits), document count, largest document id. Documents probe the arrays, and the count found
there decides. A key of one document alone takes no room: a probe that finds no fingerprint means a count of one.
Where all shards together fit ``broadcast_bytes``, they are broadcast and the documents are probed where they are
read; beyond it the (document, key) pairs are routed to their shard, and a hot shard is split by salts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import NULL_ID, arrow_map, only, table, texts, written

STRIP = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 50_000
BROADCAST_BYTES = 32 << 20
SALT_ROWS = 200_000
GAMMA = 1.5
LEVELS = 40


# -- minimal perfect hash -------------------------------------------------------------------------------------


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key that is alone in its slot of a level stays there, the others go to the next.

    A key's index is the number of bits set before its own. Keys must be distinct 64-bit integers; those still
    not alone after ``LEVELS`` levels (hardly ever any) are kept in a sorted array.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.before = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left) and len(levels) < LEVELS:
            size = max(8, int(len(left) * GAMMA) + 1)
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for some that aren't in the set (others get any index: check a fingerprint)."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for n, bits in enumerate(self.levels):
            if not len(todo):
                return out
            at = (_mix(keys[todo], n) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.before[n] + self.ranks[n][at[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = self.before[-1] + at[hit]
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return b"".join([np.packbits(x).tobytes() for x in self.levels] + [self.rest.astype("<u8").tobytes()]), [len(x) for x in self.levels]

    @classmethod
    def load(cls, raw: bytes, sizes: list[int]) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at), count=n).astype(bool))
            at += (n + 7) // 8
        return cls(levels, np.frombuffer(raw, "<u8", offset=at).astype(np.uint64))


_REST = [("hi", "<u8"), ("lo", "<u8"), ("docs", "<i8"), ("last", "<i8")]


class Shard:
    """A perfect hash of keys' first halves with the arrays it indexes; ``rest`` holds keys whose first half another key has."""

    def __init__(self, hashed: PerfectHash, fingerprint: np.ndarray, docs: np.ndarray, last: np.ndarray, rest: np.ndarray):
        self.hashed, self.fingerprint, self.docs, self.last, self.rest = hashed, fingerprint, docs, last, rest

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, largest id) of each key; of keys that aren't in the shard (1, any)."""
        at = self.hashed.index(hi)
        found = at >= 0
        found[found] = self.fingerprint[at[found]] == lo[found]
        docs, last = np.ones(len(hi), np.int64), np.zeros(len(hi), np.int64)
        docs[found], last[found] = self.docs[at[found]], self.last[at[found]]
        for r in self.rest:  # hardly ever any
            same = (hi == r["hi"]) & (lo == r["lo"])
            docs[same], last[same] = r["docs"], r["last"]
        return docs, last


SHARD_SCHEMA = "shard long, sizes array<int>, bits binary, fingerprint binary, docs binary, last binary, rest binary"


def build_shard(pdf):
    import pandas as pd

    pdf = pdf.sort_values(["hi", "lo"])
    again = pdf["hi"].duplicated()
    pick, extra = pdf[~again], pdf[again]
    rest = np.zeros(len(extra), _REST)
    for c in ("hi", "lo"):
        rest[c] = extra[c].to_numpy(np.int64).view(np.uint64)
    rest["docs"], rest["last"] = extra["docs"], extra["last"]
    keys = pick["hi"].to_numpy(np.int64).view(np.uint64)
    hashed = PerfectHash.build(keys)
    order = np.empty(len(keys), np.int64)
    order[hashed.index(keys)] = np.arange(len(keys))
    raw, sizes = hashed.dump()
    pick = pick.iloc[order]
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])],
            "sizes": [sizes],
            "bits": [raw],
            "fingerprint": [pick["lo"].to_numpy("<i8").tobytes()],
            "docs": [pick["docs"].to_numpy(np.int64).clip(max=2**32 - 1).astype("<u4").tobytes()],
            "last": [pick["last"].to_numpy("<i8").tobytes()],
            "rest": [rest.tobytes()],
        }
    )


def load_shard(row) -> Shard:
    part = lambda c, kind: np.frombuffer(bytes(row[c]), kind)
    return Shard(PerfectHash.load(bytes(row["bits"]), list(row["sizes"])), part("fingerprint", "<u8"), part("docs", "<u4"), part("last", "<i8"), part("rest", _REST))


# -- lines ----------------------------------------------------------------------------------------------------


def line_hashes(text: str, min_chars: int) -> tuple[list[str], list[int], bytes]:
    """The lines, the places of those whose key has ``min_chars`` code points, and their keys' 128-bit hashes."""
    lines, places, hashes = text.split("\n"), [], []
    for n, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip(STRIP)) >= min_chars:
            places.append(n)
            hashes.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
    return lines, places, b"".join(hashes)


def _halves(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, row: str | None = None) -> DataFrame:
    """(hi, lo, id): the distinct line keys of each row, with its column ``row`` (a long) if one is named."""
    names = ("doc_id", "text", *([row] if row else []))

    def make():
        def f(batch):
            raw, ids, rows = [], [], []
            marks = batch.column(row).to_pylist() if row else [0] * batch.num_rows
            for doc, text, mark in zip(batch.column("doc_id").to_pylist(), texts(batch), marks):
                hashes = line_hashes(text, min_chars)[2]
                own = {hashes[i : i + 16] for i in range(0, len(hashes), 16)}
                raw += own
                ids += [NULL_ID if doc is None else doc] * len(own)
                rows += [mark] * len(own)
            hi, lo = _halves(b"".join(raw))
            return {"hi": pa.array(hi.view(np.int64)), "lo": pa.array(lo.view(np.int64)), "id": pa.array(ids, pa.int64()), "row": pa.array(rows, pa.int64())}

        return f

    return arrow_map(only(docs, *names), "hi long, lo long, id long" + ", row long" * bool(row), make)


def build_shards(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(shards over the distinct keys that two rows or more hold, as a written table; their number)."""
    shared = written(keys.groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.max("id").alias("last")).where("docs > 1"), "lines-shared")
    n = max(1, -(-shared.count() // shard_keys))
    return written(shared.withColumn("shard", F.pmod("hi", F.lit(n).cast("long"))).groupBy("shard").applyInPandas(build_shard, SHARD_SCHEMA), "lines-shards"), n


def _drop_lines(text: str, doc: int, min_chars: int, probe) -> tuple[str, int, int]:
    lines, places, raw = line_hashes(text, min_chars)
    if not places:
        return text, len(lines), 0
    drop = {n for n, gone in zip(places, probe(*_halves(raw), doc)) if gone}
    return "\n".join([x for n, x in enumerate(lines) if n not in drop]) if drop else text, len(lines), len(drop)


def _probe_local(shards: list[Shard | None], n: int, min_docs: int):
    """A function of (hi, lo, doc): which of a document's keys go."""

    def probe(hi, lo, doc):
        which = _shard_of(hi, n)
        gone = np.zeros(len(hi), bool)
        for s in np.unique(which):
            if shards[s] is not None:
                m = which == s
                docs, last = shards[s].probe(hi[m], lo[m])
                gone[m] = (docs >= min_docs) & (last != doc)
        return gone

    return probe


def _shard_of(hi: np.ndarray, n: int) -> np.ndarray:
    return hi.view(np.int64) % n  # as pmod: never negative


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: tuple[str, ...] = (), shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop the lines that many documents share from all but the largest doc_id that holds them.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of ``min_chars`` code
    points or more in ``min_docs`` (2 or more) rows or more go everywhere but in the rows of the largest doc_id holding them.
    Returns doc_id, text (what stays, joined by newlines), n_lines (before dropping), n_dropped and the columns in ``carry``.
    Other columns are ignored, so names can't clash. Null text: one empty line. A row is a document: repeated rows
    each count, and rows of equal doc_id keep or lose lines alike. Null doc_id: smaller than any other. Very long
    texts and lines are read whole. No rows: no rows.
    """
    if min_docs < 2:
        raise ValueError("lines of one document alone aren't indexed")
    shards, n = build_shards(line_keys(docs, min_chars), shard_keys)
    size = shards.agg(F.sum(sum(F.length(c) for c in ("bits", "fingerprint", "docs", "last", "rest")))).first()[0] or 0
    return (_probe_broadcast if size <= broadcast_bytes else _probe_routed)(docs, shards, n, min_chars, min_docs, carry)


def _probe_broadcast(docs: DataFrame, shards: DataFrame, n: int, min_chars: int, min_docs: int, carry: tuple[str, ...]) -> DataFrame:
    rows = [r.asDict() for r in shards.collect()]  # at most ``broadcast_bytes``
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def make():
        loaded: list[Shard | None] = [None] * n
        for r in sent.value:
            loaded[r["shard"]] = load_shard(r)
        probe = _probe_local(loaded, n, min_docs)

        def f(batch):
            ids = batch.column("doc_id").to_pylist()
            made = [_drop_lines(t, NULL_ID if d is None else d, min_chars, probe) for d, t in zip(ids, texts(batch))]
            return {"doc_id": batch.column("doc_id"), "text": [m[0] for m in made], "n_lines": [m[1] for m in made], "n_dropped": [m[2] for m in made]} | {c: batch.column(c) for c in carry}

        return f

    own = only(docs, "doc_id", "text", *carry)
    return arrow_map(own, _out_schema(own, carry), make)


def _out_schema(own: DataFrame, carry: tuple[str, ...]):
    from pyspark.sql import types as T

    kinds = {f.name: f.dataType for f in own.schema}
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] + [T.StructField(c, kinds[c]) for c in carry])


def _probe_routed(docs: DataFrame, shards: DataFrame, n: int, min_chars: int, min_docs: int, carry: tuple[str, ...]) -> DataFrame:
    """Beyond the broadcast bound: keys go to their shard, the verdicts come back by doc_id and a hash of the text."""
    import pandas as pd

    row = F.xxhash64(F.coalesce("text", F.lit("")))
    keys = line_keys(docs.select("*", row.alias("__row")), min_chars, "__row").withColumn("shard", F.pmod("hi", F.lit(n).cast("long")))
    loads = keys.groupBy("shard").count().select("shard", F.ceil(F.col("count") / SALT_ROWS).alias("salts"))
    loads = F.broadcast(written(loads, "lines-loads"))  # a row a shard
    keys = keys.join(loads, "shard").withColumn("salt", F.pmod(F.xxhash64("id", "row", "lo"), F.col("salts"))).drop("salts")
    spread = shards.join(loads, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    out = "id long, row long, hi long, lo long"

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in out.split(", ")]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in names})
        many, last = load_shard(right.iloc[0]).probe(left["hi"].to_numpy(np.int64).view(np.uint64), left["lo"].to_numpy(np.int64).view(np.uint64))
        return left.loc[(many >= min_docs) & (last != left["id"].to_numpy()), names]

    gone = keys.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(probe, out)
    gone = gone.distinct().groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_list(F.struct("hi", "lo")).alias("__gone"))  # no more than a text's own lines
    own = only(docs, "doc_id", "text", *carry)
    both = own.withColumns({"__id": F.coalesce("doc_id", F.lit(NULL_ID)), "__row": row}).join(gone, ["__id", "__row"], "left")

    def make():
        def f(batch):
            made = []
            for d, t, gone in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("__gone").to_pylist()):
                drop = {(g["hi"] % 2**64, g["lo"] % 2**64) for g in gone or ()}
                made.append(_drop_lines(t, d, min_chars, lambda hi, lo, _: [(int(a), int(b)) in drop for a, b in zip(hi, lo)]))
            return {"doc_id": batch.column("doc_id"), "text": [m[0] for m in made], "n_lines": [m[1] for m in made], "n_dropped": [m[2] for m in made]} | {c: batch.column(c) for c in carry}

        return f

    return arrow_map(both, _out_schema(own, carry), make)


# -- query ----------------------------------------------------------------------------------------------------


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM d),
k AS (
  SELECT row, doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT row) >= 5),
m AS (
  SELECT k.row, k.doc_id, k.n, k.line, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY row, doc_id
"""
