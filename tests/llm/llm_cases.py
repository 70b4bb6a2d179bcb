"""Rows that every operator must take: nulls, empty and long texts, repeated rows, ties, columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, tokens string, score double, hi long, fp string, piece string, topic string, length string, component_id string, n_lines string"


def rows(n=40, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta,", "THETA!!", "iota", "über", "ça", "日本"]
    common = "this very line of more than forty code points is shared by many documents"
    out = []
    for i in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), ("  " if i % 2 else "") + (common.upper() if i % 4 else common))
        out.append((i * 3, "\n".join(lines)))
    out += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "\n\n"), (None, "a row without an id"), (None, None), (1004, "one"), (1005, "word " * 30_000)]
    out += [(1006, out[2][1]), (1007, out[2][1]), out[4], out[4]]
    langs, sources = ["en", "de", None], ["s0", "s1", "s2", None]
    return [(i, t, langs[k % 3], sources[k % 4 if k % 5 else 0], None if t is None else len(t), 7, "x", 0.5, 3, "f", "p", "t", "l", "c", "n") for k, (i, t) in enumerate(out)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def simple(spark, pairs):
    return spark.createDataFrame([(i, t) for i, t in pairs], "doc_id long, text string")
