"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash finds candidates, the sets decide. The fingerprints are two of 64 bits, from two hashes of each shingle, in eight
blocks of 15 bits; of similar texts some 15 % of the bits differ. Texts that differ in ``RADIUS`` = 23 bits or fewer
differ in at most 2 in one of the blocks, and most pairs beyond do. Anchors of a block are the words of the
Hamming code of length 15 (covering radius 1). The block halfway between two texts' has its home anchor within 2 of both,
so a text is dealt to the anchors within 2 (8 at most) and meets its partners there. Sizes of similar sets lie in
one or two neighbouring classes of ratio 1.25, which deal anchors further. Pairs of ``MOST`` differing bits or fewer are candidates,
unless their odd sketches tell them apart: each bit is the parity of the shingles that fall on it, so two sketches differ in no more bits than
the sets in shingles, and a pair beyond the difference that ``SIMILARITY`` allows is surely none. Of texts of some 200 shingles
or fewer this leaves few pairs that fail; of longer ones it leaves more and still loses none. Before sets are joined, their ``load``, the
counts of their shingles in buckets (some 4 to 8 in each), drops pairs by the same bound at any length: counts differ by no more than the sets.

Dense groups don't give all their pairs: first the spanning links of 3 bits or fewer are verified. Then, for each pair of
``FIRST`` blocks, each group gives its nearest partner at each anchor alone, and what is verified joins groups. Only pairs
whose ends aren't in one group by then are searched in whole, ``WIDE`` blocks at a time, so that the files of one search are gone
before the next. Texts stay where they are unless they are of a pair that may be similar.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, discard, few, files_released, only, texts, written
from corpusloom.llm.components import components
from corpusloom.llm.simhash import BITS, SEED, links

WORDS = 5
SIMILARITY = 0.8
BLOCK_THRESHOLD = 2
LENGTH = 15
BLOCKS = 8
RADIUS = BLOCKS * (BLOCK_THRESHOLD + 1) - 1
MOST = 36
CELLS = 4_000_000
SKETCH = 128
#: Share of the shingles of two similar sets that one set alone holds, at most.
ALLOWED = (1 - SIMILARITY) / (1 + SIMILARITY)
#: Blocks of the rounds in which each group looks for its nearest partner alone, in its own size class.
FIRST = ((0, 1), (4, 5))
#: Blocks that are searched in whole together.
WIDE = ((0, 1), (2, 3), (4, 5), (6, 7))

# -- sets and fingerprints ------------------------------------------------------------------------------------


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the runs of ``words`` words; of fewer words the one run, of none nothing."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[i:j], SEED) for i, j in zip(starts, ends)], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def mingled(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles (SplitMix64's last steps)."""
    x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Two words of ``SKETCH`` bits: of distinct ``hashes`` the parity of those that fall on each."""
    parity = np.bincount((mingled(hashes) >> np.uint64(57)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<u8")


def load(hashes: np.ndarray) -> bytes:
    """Their number (four bytes), and how many of the ``hashes`` (255 at most) fall in each of a power of two of buckets, by their first bits."""
    bits = max(0, len(hashes).bit_length() - 3)
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(hashes)])
    return len(hashes).to_bytes(4, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sets of these loads (as bytes) may be similar: in the fewer buckets of the two, counts differ by no more than the sets."""
    n = sum(int.from_bytes(x[:4].tobytes(), "little") for x in (a, b))
    buckets = min(len(a), len(b)) - 4
    x, y = (np.minimum(v[4:].astype(np.int64).reshape(buckets, -1).sum(axis=1), 255) for v in (a, b))
    return int(np.abs(x - y).sum()) <= ALLOWED * n + 1e-9


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _node():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _prints(rows: DataFrame) -> DataFrame:
    def make():
        def f(batch):
            made = [shingles(t) for t in texts(batch)]
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            odd = np.array([odd_sketch(s) for s in made], np.uint64).reshape(-1, 2)
            own = {"fp": signed([majority(s) for s in made]), "fp2": signed([majority(mingled(s)) for s in made]), "odd": signed(odd[:, 0]), "odd2": signed(odd[:, 1])}
            return {"node": batch.column("node")} | own | {"n": pa.array([len(s) for s in made], pa.int32()), "load": [load(s) for s in made]}

        return f

    return arrow_map(rows, "node long, fp long, fp2 long, odd long, odd2 long, n int, load binary", make, 256)


# -- search ---------------------------------------------------------------------------------------------------


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the flips that give the code words within 2, and which of them count."""
    from itertools import combinations

    found: list[list[int]] = [[] for _ in range(LENGTH + 1)]
    for k in range(BLOCK_THRESHOLD + 1):
        for at in combinations(range(1, LENGTH + 1), k):
            s = 0
            for i in at:
                s ^= i
            found[s].append(sum(1 << (i - 1) for i in at))
    most = max(map(len, found))
    flips, counts = np.zeros((LENGTH + 1, most), np.int64), np.zeros((LENGTH + 1, most), bool)
    for s, own in enumerate(found):
        flips[s, : len(own)], counts[s, : len(own)] = own, True
    return flips, counts


_FLIPS, _COUNTS = _flips()
_CHECKS = [sum(1 << (p - 1) for p in range(1, LENGTH + 1) if p >> k & 1) for k in range(4)]


def dealt(fps: np.ndarray, fps2: np.ndarray, sizes: np.ndarray, blocks=range(BLOCKS), above: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place in ``fps``, is in its own class, not the one ``above``) of every replica."""
    level = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1 / SIMILARITY) + 1e-9).astype(np.int64)
    place, keys, places, owns = np.arange(len(fps)), [], [], []
    for block in blocks:
        words = _block(fps, fps2, block)
        s = sum(((np.bitwise_count(words & m) & 1).astype(np.int64) << k for k, m in enumerate(_CHECKS)), np.zeros(len(words), np.int64))
        keep = _COUNTS[s]
        near, at = (words[:, None] ^ _FLIPS[s])[keep], np.broadcast_to(place[:, None], keep.shape)[keep]
        for up in (0, 1)[: 1 + above]:
            keys.append((level[at] + up) << 20 | block << LENGTH | near)
            places.append(at)
            owns.append(np.full(len(at), not up))
    return np.concatenate(keys), np.concatenate(places), np.concatenate(owns)


def _block(fp: np.ndarray, fp2: np.ndarray, block: int) -> np.ndarray:
    return (((fp, fp2)[block // 4] >> np.uint64(block % 4 * LENGTH)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)


def _met(key: int, nearest: bool, own: np.ndarray, fp: np.ndarray, fp2: np.ndarray, odd: np.ndarray, odd2: np.ndarray, n: np.ndarray, node: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of one key that differ in ``MOST`` bits at most, of sizes and sketches that can be similar, and in two groups.

    A pair that surely meets in an earlier block isn't given again, nor one of equal words but at one of their anchors.
    ``nearest``: of each group the nearest pair alone, of equally near ones that of the least nodes.
    """
    block, anchor = key >> LENGTH & 0x1F, key & ((1 << LENGTH) - 1)
    values, counts = np.unique(root, return_counts=True)
    if len(values) == 1 or not own.any():
        return
    fp, fp2, odd, odd2 = (x.view(np.uint64) for x in (fp, fp2, odd, odd2))
    large = root == values[counts.argmax()]  # a group that fills the key isn't compared with itself
    for x, y in ((np.flatnonzero(large), np.flatnonzero(own & ~large)), (np.flatnonzero(~large), np.flatnonzero(own))):
        x = x[np.argsort(root[x], kind="stable")]
        step = max(1, CELLS // max(1, len(y)))
        for at in range(0, len(x) if len(y) else 0, step):
            z = x[at : at + step]
            bits = np.bitwise_count(fp[z][:, None] ^ fp[y][None, :]) + np.bitwise_count(fp2[z][:, None] ^ fp2[y][None, :])
            i, j = np.nonzero(bits <= MOST)
            bits, i, j = bits[i, j], z[i], y[j]
            fit = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]) - 1e-9)
            bits, i, j = bits[fit], i[fit], j[fit]
            fit = np.bitwise_count(odd[i] ^ odd[j]).astype(np.int64) + np.bitwise_count(odd2[i] ^ odd2[j]) <= ALLOWED * (n[i].astype(np.int64) + n[j]) + 1e-9
            bits, i, j = bits[fit], i[fit], j[fit]
            if not nearest:
                p, q = fp[i] ^ fp[j], fp2[i] ^ fp2[j]
                first = (_block(p, q, block) > 0) | (np.bitwise_count(_block(fp[i], fp2[i], block) ^ anchor) <= 1)
                for earlier in range(block):
                    first &= np.bitwise_count(_block(p, q, earlier)) > BLOCK_THRESHOLD
                bits, i, j = bits[first], i[first], j[first]
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            if nearest and len(a):
                order = np.lexsort((b, a, bits, root[i]))
                order = order[np.concatenate([[True], np.diff(root[i][order]) != 0])]
                a, b = a[order], b[order]
            yield a, b


def candidates(nodes: DataFrame, blocks: tuple[int, ...] = tuple(range(BLOCKS)), nearest: bool = False) -> DataFrame:
    """(a, b): pairs of ``nodes`` (node, fp, fp2, odd, odd2, n, root) that meet at an anchor within ``MOST`` bits, of sizes and sketches that can be similar, whose roots differ.

    ``nearest``: at each anchor of the ``blocks``, each group's nearest pair within its size class alone.
    """
    names = ("fp", "fp2", "odd", "odd2", "n", "node", "root")

    def make():
        def f(batch):
            own = {c: batch.column(c).to_numpy() for c in names}
            key, place, first = dealt(own["fp"].view(np.uint64), own["fp2"].view(np.uint64), own["n"], blocks, not nearest)
            return {"key": pa.array(key), "own": pa.array(first)} | {c: pa.array(x[place]) for c, x in own.items()}

        return f

    rows = arrow_map(only(nodes, *names), "key long, own boolean, fp long, fp2 long, odd long, odd2 long, n int, node long, root long", make, 2_000)
    rows = rows.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def made(cols):
            key = cols[0]
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            some = np.flatnonzero(np.diff(cuts) > 1)
            found = [p for i, j in zip(cuts[some].tolist(), cuts[some + 1].tolist()) for p in _met(int(key[i]), nearest, *[c[i:j] for c in cols[1:]]) if len(p[0])]
            if found:
                a, b = np.unique(np.stack([np.concatenate(x) for x in zip(*found)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held and new[0][-1] == held[0][0][0]:  # the key goes on
                held.append(new)
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))
            yield from made([np.concatenate(x) for x in zip(*held, [c[:cut] for c in new])])
            held = [[c[cut:] for c in new]]
        if held:
            yield from made([np.concatenate(x) for x in zip(*held)])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return few(written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-ends"))


def _both(pairs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``pairs`` with ``name`` of both ends, as x and y."""
    end = lambda c, to: found.select(F.col("node").alias(c), F.col(name).alias(to))
    return pairs.join(end("a", "x"), "a").join(end("b", "y"), "b").select("a", "b", "x", "y")


def _kept(both: DataFrame, kind: type, test) -> DataFrame:
    def check():
        def f(batch):
            own = lambda c: [np.frombuffer(r, kind) for r in batch.column(c).to_pylist()]
            return {"a": batch.column("a"), "b": batch.column("b"), "ok": [test(x, y) for x, y in zip(own("x"), own("y"))]}

        return f

    return arrow_map(both, "a long, b long, ok boolean", check, 256).where("ok").select("a", "b")


def likely(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose loads don't rule out that their sets are similar."""
    loads = prints.select("node", "load").join(_ends(pairs), "node", "left_semi")
    return _kept(_both(pairs, loads, "load"), np.uint8, alike)


def verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose texts are similar. Sets are made once a node, of the nodes in likely pairs alone."""
    pairs = written(likely(prints, pairs), "near-likely")
    found = only(docs, "text").select(_node().alias("node"), F.coalesce("text", F.lit("")).alias("text")).join(_ends(pairs), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    make = lambda: lambda b: {"node": b.column("node"), "raw": [shingles(t).tobytes() for t in texts(b)]}
    sets = written(arrow_map(found, "node long, raw binary", make, 256), "near-sets")
    return _kept(_both(pairs, sets, "raw"), np.uint64, similar)


def near_copies(docs: DataFrame) -> DataFrame:
    """(node, root) of each distinct text that has a near copy: ``node`` is ``xxhash64`` of the text (null: empty), ``root`` its group's least node.

    Groups are connected by similarities of ``SIMILARITY`` or more. Texts without words are alike. No rows: no rows.
    """
    with files_released(docs.sparkSession):
        return _near_copies(docs)


def _near_copies(docs: DataFrame) -> DataFrame:
    # Of repeated texts one is read: hashes are dealt, texts stay where they are.
    every = written(_prints(only(docs, "text").select(_node().alias("node"), F.coalesce("text", F.lit("")).alias("text"))), "near-prints")
    prints = written(every.dropDuplicates(["node"]), "near-nodes")
    discard(every)
    least = prints.groupBy("fp").agg(F.min("node").alias("first"))
    same = prints.join(least, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = links(prints.select("fp").distinct()).toDF("p", "q").distinct()
    close = close.join(least.toDF("p", "a"), "p").join(least.toDF("q", "b"), "q").select("a", "b")
    sure = written(verified(docs, prints, written(same.unionByName(close), "near-close")), "near-sure")

    def grouped(links: DataFrame) -> DataFrame:
        roots = written(components(links, "near-groups"), "near-roots")
        return prints.where("n > 0").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    for blocks in FIRST:
        near = written(candidates(grouped(sure), blocks, nearest=True), "near-next")
        sure = written(sure.unionByName(verified(docs, prints, near)), "near-sure")
    left = grouped(sure)
    wide = [written(candidates(left, blocks), "near-wide") for blocks in WIDE]
    more = verified(docs, prints, written(reduce(DataFrame.unionByName, wide).distinct(), "near-wide"))
    return written(components(sure.unionByName(more), "near-all"), "near-found")
