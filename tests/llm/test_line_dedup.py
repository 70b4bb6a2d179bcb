import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import empty, frame, rows, simple

from corpusloom.llm import line_dedup as ld


def brute(data, min_chars=40, min_docs=5):
    def key(line):
        k = line.strip(ld.STRIP)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    held = {}
    for n, (doc, text) in enumerate(data):
        for line in set(map(key, (text or "").split("\n"))):
            if len(line) >= min_chars:
                held.setdefault(line, []).append(ld.NULL_ID if doc is None else doc)
    out = []
    for doc, text in data:
        lines = (text or "").split("\n")
        own = ld.NULL_ID if doc is None else doc
        keep = [x for x in lines if not (len(held.get(key(x), [])) >= min_docs and max(held[key(x)]) != own)]
        out.append((doc, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"shard_keys": 2}, {"broadcast_bytes": -1}, {"broadcast_bytes": -1, "shard_keys": 2}])
def test_as_brute_force(spark, how):
    data = [(r[0], r[1]) for r in rows()] + [(5000 + i, f"a line that is long enough to count, number {i % 3}, of them all\nown {i}") for i in range(30)]
    got = [tuple(r) for r in ld.line_dedup(simple(spark, data), **how).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=str) == brute(data)


def test_sql_with_repeated_and_null_ids(spark):
    import duckdb
    import pandas as pd

    line = "a line that is long enough to be counted, whoever holds it"
    data = [(7, f"{line}\nx"), (7, f"{line}\nx"), (7, f"{line}\ny"), (None, line), (None, f"{line.upper()} \n"), (3, None), (None, None), (2, f"{line}2"), (None, f"{line}2")]
    documents = pd.DataFrame(data, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted([(d, n, k) for d, n, k, _ in con.execute(ld.ORACLE).fetchall()], key=str)
    for how in ({}, {"broadcast_bytes": -1}):
        got = [tuple(r) for r in ld.line_dedup(simple(spark, data), **how).select("doc_id", "n_lines", "n_dropped").collect()]
        assert sorted(got, key=str) == want == sorted([(d, n, k) for d, _, n, k in brute(data)], key=str)
    assert sum(k for _, _, k in want) == 2


@pytest.mark.parametrize("min_docs", [2, 3])
def test_keys_of_equal_halves_and_strangers(min_docs):
    import pandas as pd

    rows = [(5, 1, 2, 10), (5, 2, 3, 20), (5, 3, 4, 30), (9, 1, 2, 40), (-7, -1, 5, 50)]
    made = ld.build_shard(pd.DataFrame([(0, *r) for r in rows], columns=["shard", "hi", "lo", "docs", "last"]))
    shard = ld.load_shard(made.iloc[0])
    hi, lo = (np.array(x, np.int64).view(np.uint64) for x in ([5, 5, 5, 9, -7, 5, 9, 8], [1, 2, 3, 1, -1, 4, 1 + 2**32, 1]))
    docs, last = shard.probe(hi, lo)
    assert docs.tolist() == [2, 3, 4, 2, 5, 1, 1, 1] and last[:5].tolist() == [10, 20, 30, 40, 50]
    gone = ld._probe_local([shard], 1, min_docs)(hi, lo, 30)
    assert gone.tolist() == [d >= min_docs and x != 30 for d, x in zip(docs.tolist(), last.tolist())]


def test_extra_columns_and_no_rows(spark):
    got = ld.line_dedup(frame(spark), carry=("lang", "source"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "lang", "source"]
    assert got.count() == len(rows())
    assert ld.line_dedup(empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash(keys):
    x = np.array(sorted(keys), np.uint64)
    h = ld.PerfectHash.build(x)
    assert sorted(h.index(x)) == list(range(len(x)))
    again = ld.PerfectHash.load(*h.dump())
    assert (again.index(x) == h.index(x)).all()
    other = np.setdiff1d(np.arange(1000, dtype=np.uint64), x)
    assert (h.index(other) < len(x)).all()


def test_keys_that_never_part_are_kept(monkeypatch):
    monkeypatch.setattr(ld, "LEVELS", 1)
    x = np.arange(1000, dtype=np.uint64)
    h = ld.PerfectHash.build(x)
    assert len(h.rest) and sorted(h.index(x)) == list(range(1000))
