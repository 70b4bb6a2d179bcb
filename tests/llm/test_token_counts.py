import random

import pytest
from llm_cases import empty, frame, rows, simple

from corpusloom.llm import token_counts as tc

PARTS = ["the ", "'s", " ", "\n", "  ", "1", "23", "é", "don't", ".", "!!", "日本", " x", "\t", "  \n "]


@pytest.mark.parametrize("leaf", [1, 2, 8, 32])
def test_edits_as_whole_recounts(leaf):
    counts, rng = tc.counter(tc.TOKENIZER), random.Random(leaf)
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))
        tree = tc.CountTree(text, counts, leaf)
        for _ in range(4):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.randrange(12))
            new = "".join(rng.choice(PARTS) for _ in range(rng.randrange(5)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert (tree.text, tree.chars, tree.tokens) == (text, len(text), len(counts.encoding.encode_ordinary(text)))


def test_little_is_encoded_again():
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = tc.CountTree(text, tc.counter(tc.TOKENIZER))
    before = tree.encoded_chars
    tree.edit(60_000, 60_003, "something new")
    assert tree.encoded_chars - before < 2_000
    with pytest.raises(ValueError):
        tree.edit(5, 4, "")


def test_operator(spark):
    data = [(r[0], r[1]) for r in rows()]
    counts, want = tc.counter(tc.TOKENIZER), []
    for doc, text in data:
        text = text or ""
        new = text
        for a, b, x in tc.standard_edits(doc, text):
            new = new[:a] + x + new[b:]
        n = lambda t: len(counts.encoding.encode_ordinary(t))
        want.append((doc, len(text), len(counts.pieces(text)), n(text), len(new), n(new)))
    got = tc.edited_counts(simple(spark, data)).select("doc_id", "n_chars", "n_pretokens", "n_tokens", "edited_chars", "edited_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tc.edited_counts(empty(spark)).count() == 0
    assert tc.edited_counts(frame(spark)).count() == len(rows())
