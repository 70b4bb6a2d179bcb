import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import words as w

ALPHABET = st.sampled_from("ab'B .\n\t\u3000é日\U0001f600")


def mixed(x, seed):
    x ^= seed * 0x9E3779B97F4A7C15 % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor % 2**64
    return x ^ (x >> 31)


def plain(word, seed):
    return mixed(sum((b + 1) * 0x9E3779B97F4A7C15**i for i, b in enumerate(word.encode())) % 2**64, seed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(ALPHABET, max_size=30), max_size=12), st.booleans(), st.integers(0, 40))
def test_words_as_python_splits(texts, lower, most):
    column = pa.array(["pad", *texts], pa.string()).slice(1)
    got = []
    for a, b in w.slices(column, most):
        places, found, ends = w.numbered(column.slice(a, b - a), lower)
        found = found.to_pylist()
        for i, j in zip([0, *ends.tolist()], ends.tolist()):
            got.append([found[p] for p in places[i:j]])
        own, place = w.distinct(places, len(found), ends)
        for n in range(b - a):
            assert {found[p] for p in place[own == n]} == set(got[a + n])
    assert got == [((t or "").lower() if lower else (t or "")).split() for t in texts]


@pytest.mark.parametrize("behind", [b"", b"\xff\xff\xff", b"\x80", b"\xe3\x80", b" \xff", b"b"])
@pytest.mark.parametrize("text", ["", "a", "a b\u3000", "a \u3000", " \n\u3000"])
def test_bytes_behind_the_last_text_do_not_count(text, behind):
    raw = text.encode()
    column = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(raw)])), pa.py_buffer(raw + behind)])
    places, found, ends = w.numbered(column)
    assert [found[p].as_py() for p in places] == text.split() and ends.tolist() == [len(text.split())]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=40), max_size=8), st.integers(0, 9))
def test_hashes_as_a_polynomial(texts, seed):
    assert w.hashes(pa.array(["x", *texts], pa.string()).slice(1), seed).tolist() == [plain(t, seed) for t in texts]


def test_hashes_spread():
    some = w.hashes(pa.array([f"w{i}" for i in range(100_000)]), 5)
    assert len(np.unique(some)) == 100_000
    count = np.bincount((some % np.uint64(64)).astype(int), minlength=64)
    assert np.abs(count - 100_000 / 64).max() < 6 * np.sqrt(100_000 / 64)
