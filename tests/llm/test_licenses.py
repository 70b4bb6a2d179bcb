import duckdb
from llm_cases import SCHEMA, empty, frame, rows

from corpusloom.llm import licenses as lc


def spoiled(text):
    return "Copyright (c) 2020 Someone\n\n" + text.replace("license", "licence").replace("License", "LICENCE").replace(" ", "  ").replace(",", " —") + "\n(C) 1999 another\n"


CASES = [(i, t) for i, t in enumerate(lc.TEXTS.values())] + [(100 + i, spoiled(t)) for i, t in enumerate(lc.TEXTS.values())]
CASES += [(200, "Licensed under the Apache License, Version 2.0."), (201, "prose\nReleased under the MIT License.\nmore\nLicensed under CC BY-NC 4.0"), (202, "this is about a license, not one"), (203, None), (204, "")]


def test_variants_are_found(spark):
    got = {r["doc_id"]: r for r in lc.licensed(spark.createDataFrame(CASES, "doc_id long, text string")).collect()}
    for i, name in enumerate(lc.TEXTS):
        assert got[i]["license_id"] == got[100 + i]["license_id"] == name
    assert got[200]["license_id"] == "Apache-2.0" == got[200]["line_licenses"]
    assert got[201]["license_id"] is None and got[201]["line_licenses"] == "CC-BY-NC-4.0,MIT"
    assert (got[202]["license_id"], got[202]["line_licenses"], got[203]["license_id"], got[204]["line_licenses"]) == (None, "", None, "")


def test_three_canonical_forms_agree(spark):
    data = [*CASES, *((r[0], r[1]) for r in rows() if r[0] is not None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    from pyspark.sql import functions as F

    for r in df.select("text", lc.canonical_column(F.coalesce("text", F.lit(""))).alias("c")).collect():
        assert r["c"] == lc.canonical(r["text"] or "")
    pdf = df.toPandas()
    con = duckdb.connect()
    con.register("documents", pdf)
    want = sorted(con.sql(lc.ORACLE).fetchall() if hasattr(con.sql(lc.ORACLE), "fetchall") else [], key=str)
    got = sorted((tuple(r) for r in lc.licensed(df).select("doc_id", "text_digest", "license_id", "line_licenses").collect()), key=str)
    assert got == want


def test_every_notice_has_a_key():
    for texts in lc.notices().values():
        assert all(any(k in t.lower() for k in lc.KEYS) for t in texts)


def test_edges(spark):
    assert lc.licensed(empty(spark)).count() == 0
    got = lc.licensed(frame(spark))
    assert got.count() == len(rows()) and got.columns == ["doc_id", "text_digest", "license_id", "line_licenses"] and "text_digest" not in SCHEMA


def test_standard_files_are_found(spark):
    import textwrap

    wrapped = {i: "\n".join(textwrap.fill(p, 70) for p in t.split("\n")) for i, t in lc.TEXTS.items()}
    data, want = [], []
    for i, titles in lc.TITLES.items():
        for title in titles:
            data.append((len(data), f"{title}\n\nCopyright (c) 2020 Someone\n\n{wrapped[i]}\n"))
            want.append(i)
    data.append((len(data), "Copyright © A. Body\n" + wrapped["ISC"].replace("provided that the above copyright", "provided that the above\ncopyright")))
    want.append("ISC")
    got = {r["doc_id"]: r["license_id"] for r in lc.licensed(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(want))] == want
    assert "jurisdictions" in lc.TEXTS["Unlicense"] and all("You should have received" in lc.TEXTS[f"GPL-{n}.0-or-later"] for n in (2, 3))


def test_every_text_has_a_key_and_is_found_on_a_line(spark):
    assert all(any(k in t.lower() for k in lc.KEYS) for t in lc.TEXTS.values())
    data = [(n, "prose before\n" + t.replace("\n", " ") + "\nprose after") for n, t in enumerate(lc.TEXTS.values())]
    got = {r["doc_id"]: r["line_licenses"] for r in lc.licensed(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[n] for n in range(len(data))] == list(lc.TEXTS)


def test_bullets_titles_and_whole_texts(spark):
    import re

    head = "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n"
    bullets = re.sub(r"(?m)^\d\. ", "* ", lc.TEXTS["BSD-3-Clause"])
    data, want = [(0, bullets), (1, head + bullets), (2, head + lc.TEXTS["BSD-3-Clause"])], ["BSD-3-Clause"] * 3
    whole = dict((i, t) for i, t in reversed(lc.whole_texts()))
    for i, text in whole.items():
        for form in (text, "\n\n" + text.replace("\n", "\r\n"), text.replace("https://", "http://").replace("  ", " "), text[: text.index(lc.END)] if lc.END in text else text):
            data.append((len(data), form))
            want.append(i)
    got = {r["doc_id"]: r["license_id"] for r in lc.licensed(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(want))] == want
    assert set(whole) == {"Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
