import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import empty, frame, rows, simple
from tokenizers import Tokenizer

from corpusloom.llm import packing as pk
from corpusloom.llm.tokens import WordTokenizer

ODD = ["it's THE'S don't'll x'", "a\x1cb c", "<|endoftext|> x<|endoftext|>y", "éa  Éß×÷ ªº ½²", "日本語 İI ΑΣ σ", "", " \n\t ", "1234 5'678's", "a b́ ́", "''s '''s 's's", " x　y\x85z", "ab—cd 'S ‘s ok\r\nx", "a\x00b \x7f c", "µm ª", "é É"]


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(pk.tokenizer_path(pk.TOKENIZER), cache=200)


def test_tokens_as_the_tokenizer(words):
    texts = ODD + [r[1] or "" for r in rows()]
    for _ in range(2):  # the second time from the cache, which is emptied on the way
        got = words.encode(texts)
        for t, g in zip(texts, got):
            assert np.frombuffer(g, "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sS tT\n.,!1234éÉß日 <|>—\x1c"), max_size=40))
def test_tokens_of_any_text(text):
    w = WordTokenizer(pk.tokenizer_path(pk.TOKENIZER)) if not hasattr(test_tokens_of_any_text, "w") else test_tokens_of_any_text.w
    test_tokens_of_any_text.w = w
    assert np.frombuffer(w.encode([text])[0], "<u4").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_nnls_as_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((8, 20)), rng.random(8)
        x = pk.nnls(a, b)
        grad = a.T @ (a @ x - b)
        assert (x >= 0).all() and grad.min() > -1e-6 and np.abs(grad[x > 0]).max(initial=0) < 1e-6


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 256), max_size=400))
def test_plans_use_every_length(lengths):
    hist = {n: lengths.count(n) for n in set(lengths)}
    made = pk.plan(hist, 256, 16)
    used = {}
    for ls, c in made:
        assert sum(ls) <= 256 and c > 0
        for n in ls:
            used[n] = used.get(n, 0) + c
    assert used == hist


def test_plans_are_tight():
    rng = np.random.default_rng(0)
    n = np.minimum(4096, rng.lognormal(6, 1.1, 20_000).astype(int) + 1)
    made = pk.plan(dict(zip(*(x.tolist() for x in np.unique(n, return_counts=True)))))
    assert sum(c for _, c in made) <= 1.002 * np.ceil(n.sum() / 4096)


@pytest.mark.parametrize("salt_rows", [3, 50_000])
def test_pack(spark, salt_rows):
    data = [(r[0], r[1]) for r in rows()]
    got = pk.pack(simple(spark, data), seq_len=512, salt_rows=salt_rows, keep_ids=True).toPandas()
    raw = Tokenizer.from_file(pk.tokenizer_path(pk.TOKENIZER))
    want = []
    for doc, text in data:
        ids = [*raw.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[s : s + 512], "<u4").tobytes()
            want.append((doc, p, s, len(part) // 4, zlib.crc32(part), part))
    have = [(None if np.isnan(d) else int(d), p, s, n, c, bytes(i)) for d, p, s, n, c, i in got[["doc_id", "piece", "start", "length", "ids_crc32", "ids"]].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        ends = (g["offset"] + g["length"]).tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 512


def test_edges(spark):
    assert pk.pack(empty(spark)).count() == 0
    assert pk.pack(frame(spark)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
