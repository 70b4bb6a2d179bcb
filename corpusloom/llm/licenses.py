"""Licence scans by canonical digests.

A text is brought to a canonical form - copyright lines out, A-Z lower-cased, equivalent spellings made one, runs of
punctuation and white space made one space, list markers out - and its SHA-256 is looked up among those of known licences and
notices. Whole texts are hash-joined to the digests; the lines of a text that can hold a notice are looked up one
by one. Column expressions do it all: there is one scan and no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import only, table

# Texts of public licences, and names that notices use.

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

#: Whole texts as their stewards publish them, a file a licence.
WHOLE = Path(__file__).parent / "licence_texts"
#: What follows in a published text, how to apply it, is often left out.
END = "END OF TERMS AND CONDITIONS"

TEXTS = {
    "MIT": MIT,
    "ISC": ISC,
    "BSD-2-Clause": _BSD_HEAD + _BSD_END,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_END,
    "Zlib": ZLIB,
    "Unlicense": UNLICENSE,
    "Apache-2.0": APACHE_NOTICE,
    "MPL-2.0": MPL_NOTICE,
    "GPL-2.0-or-later": GPL_NOTICE.format(n=2),
    "GPL-3.0-or-later": GPL_NOTICE.format(n=3),
}

#: Title lines that stand above a text; each text is known with and without them.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: How notices name a licence.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "Zlib": ("zlib License",),
    "Unlicense": ("Unlicense",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
}
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = ("2.0", "3.0", "4.0")
NOTICES = ("Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "This project is licensed under the {}", "This file is licensed under the {}")

#: Signs made spaces, and spellings made one; on lower-cased text, in this order.
SIGNS = "“”‘’«»–—‐‑…·•©®™ "
SPELLINGS = (
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("noninfringement", "non infringement"),
    ("non-", "non"),
    ("non ", "non"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("https:", "http:"),
    ("per cent", "percent"),
    ("sub-license", "sublicense"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copyright is followed by (c), a year, or a sign (a space by now, between two).
COPYRIGHT_LINES = r"(^|\n)[ \t#*/;%-]*(copyright([ \t]*(\(c\)|[0-9])|[ \t]{3})|\(c\)|all rights reserved)[^\n]*"
#: Numbers and letters of list items, which some copies replace by bullets.
MARKERS = r"(^|\n)[ \t#*/;%-]*\(?([0-9]{1,2}|[a-z])[.)][ \t]+"
BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Every known text and notice holds one of these once A-Z are lower-cased; lines without can't be one.
KEYS = ("licens", "licenc", "spdx", "released", "distributed", "public", "redistribut", "permission")


def notices() -> dict[str, tuple[str, ...]]:
    names = dict(NAMES)
    for kind, versions in _GNU_VERSIONS.items():
        for v in versions:
            full = v if "." in v else f"{v}.0"
            names[f"{kind}-{full}"] = (f"{_GNU[kind]}, version {v}", f"{_GNU[kind]} v{v}", f"{kind}v{v}", f"{kind}-{full}")
    for kind, name in _CC.items():
        for v in _CC_VERSIONS:
            names[f"CC-{kind}-{v}"] = (f"CC {kind} {v}", f"CC-{kind}-{v}", f"Creative Commons {name} {v}", f"Creative Commons {name} {v} International License")
    return {i: tuple(n.format(x) for x in own for n in NOTICES) + (f"SPDX-License-Identifier: {i}",) for i, own in names.items()}


# -- canonical form, three times: Python for the catalogue, columns, SQL for the check ------------------------------


def canonical(text: str) -> str:
    x = text.translate(str.maketrans(UPPER, LOWER)).translate(str.maketrans(dict.fromkeys(SIGNS, " ")))
    x = re.sub(COPYRIGHT_LINES, r"\1", x)
    x = re.sub(MARKERS, r"\1", x)
    for a, b in SPELLINGS:
        x = x.replace(a, b)
    return re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", x).strip(" ")


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the published texts: whole, and up to the end of their terms with and without the line that says so."""
    found = []
    for path in sorted(WHOLE.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.stem, text))
        if END in text:
            terms = text[: text.index(END)]
            found += [(path.stem, terms + END), (path.stem, terms)]
    return found


@cache
def catalogue() -> tuple[tuple[str, str], ...]:
    """(digest, licence) of all known texts and notices; where two have one canonical form, the first."""
    found: dict[str, str] = {}
    # On one line the items of a list keep their markers, so each text is known in that form as well.
    for licence, text in [*TEXTS.items(), *whole_texts(), *((i, f"{x}\n\n{TEXTS[i]}") for i, own in TITLES.items() for x in own), *((i, t) for i, ts in notices().items() for t in ts)]:
        for form in (text, " ".join(text.split())):
            found.setdefault(hashlib.sha256(canonical(form).encode()).hexdigest(), licence)
    return tuple(found.items())


def canonical_column(text: F.Column) -> F.Column:
    x = F.translate(F.translate(text, UPPER, LOWER), SIGNS, " " * len(SIGNS))
    x = F.regexp_replace(F.regexp_replace(x, COPYRIGHT_LINES, "$1"), MARKERS, "$1")
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, BETWEEN, " "))


def digest_column(text: F.Column) -> F.Column:
    return F.sha2(F.encode(canonical_column(text), "UTF-8"), 256)


def _canonical_sql(x: str) -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"translate(translate({x}, '{UPPER}', '{LOWER}'), {lit(SIGNS)}, '{' ' * len(SIGNS)}')"
    for pattern in (COPYRIGHT_LINES, MARKERS):
        x = f"regexp_replace({x}, {lit(pattern)}, '\\1', 'g')"
    for a, b in SPELLINGS:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return f"trim(regexp_replace({x}, {lit(BETWEEN)}, ' ', 'g'), ' ')"


# -- operator -------------------------------------------------------------------------------------------------


def licensed(docs: DataFrame) -> DataFrame:
    """doc_id, text_digest, license_id (of the whole text, or null), line_licenses (those of its lines, sorted, joined by commas; or empty).

    Null text: as empty, whose digest no licence has. Very long texts are read whole. Null doc_id: returned as null.
    Repeated rows: a row each. Other columns are ignored. No rows: no rows.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list(catalogue()), "text_digest string, license_id string")
    by_digest = F.create_map(*[F.lit(x) for pair in catalogue() for x in pair])
    own = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    def has_key(line):
        low = F.translate(line, UPPER, LOWER)
        found = F.contains(low, F.lit(KEYS[0]))
        for k in KEYS[1:]:
            found = found | F.contains(low, F.lit(k))
        return found

    lines = F.transform(F.filter(F.split("text", "\n", -1), has_key), lambda x: F.try_element_at(by_digest, digest_column(x)))
    found = F.array_join(F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.isNotNull()))), ",")
    own = own.select("doc_id", digest_column(F.col("text")).alias("text_digest"), F.when(has_key(F.col("text")), found).otherwise(F.lit("")).alias("line_licenses"))
    return own.join(F.broadcast(known), "text_digest", "left").select("doc_id", "text_digest", "license_id", "line_licenses")


# -- query ----------------------------------------------------------------------------------------------------


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join(f"('{d}', '{i}')" for d, i in catalogue())
    return f"""
WITH known(text_digest, license_id) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, doc_id, sha256({_canonical_sql('text')}) AS text_digest FROM d),
l AS (SELECT n, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT n, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS line_licenses
      FROM (SELECT n, sha256({_canonical_sql('line')}) AS g FROM l WHERE regexp_matches(translate(line, '{UPPER}', '{LOWER}'), '{'|'.join(KEYS)}')) x
      JOIN known k ON k.text_digest = x.g GROUP BY n)
SELECT w.doc_id, w.text_digest, k.license_id, coalesce(m.line_licenses, '') AS line_licenses
FROM w LEFT JOIN known k USING (text_digest) LEFT JOIN m USING (n)
"""


ORACLE = _oracle()
