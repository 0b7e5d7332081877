"""Licence scans by canonical digest lookup (DataFrame functions only).

A text is made canonical (case, punctuation, copyright lines, equivalent spellings), hashed, and its digest joined to
the digests of known licence texts. The texts looked up are the whole document and, so that a licence pasted into a
longer document is found as well, each of its paragraphs and lines, and the runs of as many paragraphs as a known text
has, always entire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import whole_text

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Public licence texts and the notices that stand for a licence. (licence, text)
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_2 = _BSD[: _BSD.index("3. Neither")] + _BSD[_BSD.index("THIS SOFTWARE IS PROVIDED BY") :]
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC[_ISC.index("THE SOFTWARE IS PROVIDED") :]
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Full texts that the SQL doesn't hold.
FULL = tuple((i, head + text) for i, title, text in (("BSD-3-Clause", "BSD 3-Clause License", _BSD), ("BSD-2-Clause", "BSD 2-Clause License", _BSD_2), ("0BSD", "BSD Zero Clause License", _0BSD), ("Zlib", "zlib License", _ZLIB), ("Unlicense", "The Unlicense", _UNLICENSE), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", _BOOST)) for head in ("", title + "\n\n"))

#: Fixed values: (spelling, the one it equals), whole words, applied in this order.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("noncommercial", "non commercial"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("https", "http"),
    ("copyright holders", "copyright owners"),
)


#: Digests that go along with every task at most, about 100 bytes each.
BROADCAST_DIGESTS = 100_000
#: A line of a copyright notice, with a mark, a year or a place for it. The SQL still has any line that starts with the word.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;>-]*(copyright[ \t:,]*(\(c\)|©|[\[<{]|(19|20)[0-9][0-9])|\(c\)[^\n]*\b(19|20)[0-9][0-9]|©)[^\n]*$"
SQL_COPYRIGHT_LINE = r"(?m)^[ \t#*/;>-]*(copyright|\(c\)|©)[^\n]*$"


#: What parts the two words of a spelling: a line may end there. The SQL has a space only.
GAP, SQL_GAP = r"(?: +| *\n *)", " "


def _steps(copyright_line: str = COPYRIGHT_LINE, gap: str = GAP) -> list[tuple[str, str]]:
    """(pattern, replacement) pairs, in order, that both Java's and RE2's regular expressions read alike."""
    return [
        (r"\r\n?", "\n"),
        (copyright_line, ""),
        (r"(?m)^[ \t#*/;>-]*all rights reserved[^\n]*$", ""),
        (r"[^\p{L}\p{N}\n]+", " "),
        *[(r"\b" + a.replace(" ", gap) + r"\b", b) for a, b in SPELLINGS],
        (r" *\n *", "\n"),
        (r"^[ \n]+", ""),
        (r"[ \n]+$", ""),
    ]


def canonical(text: Column) -> Column:
    """The canonical text, lines kept; null counts as empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    steps = _steps()
    spelled = [s for s in steps if s[0].startswith(r"\b")]
    any_spelling = "|".join(pattern for pattern, _ in spelled)
    for i, (pattern, by) in enumerate(steps):
        if (pattern, by) not in spelled:
            out = F.regexp_replace(out, pattern, by)
        elif steps[i - 1] not in spelled:  # few texts hold any of the spellings
            chain = out
            for p, b in spelled:
                chain = F.regexp_replace(chain, p, b)
            out = F.when(out.rlike(any_spelling), chain).otherwise(out)
    return out


def _paragraphs(canon: Column) -> Column:
    return F.transform(F.split(canon, r"\n\n+"), lambda p: F.translate(p, "\n", " "))


def _units(canon: str, parts: str, firsts: dict[int, list[int]]) -> Column:
    """array<struct<scope, unit>>: the whole text, its paragraphs, runs of them and its lines, without empty ones.

    `firsts` has the hashes of the first paragraphs of the known texts by their number of paragraphs; no other runs are formed.
    """
    one = lambda s, flat: F.struct(F.lit(s).alias("scope"), flat.alias("unit"))
    squeeze = lambda c: F.regexp_replace(c, r"\n+", " ")
    none = F.array().cast("array<struct<scope:string,unit:string>>")
    whole = F.array(one("text", squeeze(F.col(canon))))
    paragraphs = F.when(F.size(parts) > 1, F.transform(parts, lambda p: one("paragraph", p)))
    lines = F.when(F.col(canon).contains("\n"), F.transform(F.split(canon, r"\n+"), lambda x: one("line", x)))

    def runs(n: int) -> Column:  # shorter than the text, which is a unit itself
        starts = F.filter(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.xxhash64(F.element_at(parts, i)).isin(firsts[n]))
        return F.coalesce(F.when(F.size(parts) > n, F.transform(starts, lambda i: one("run", F.array_join(F.slice(parts, i, F.lit(n)), " ")))), none)

    return F.filter(F.concat(whole, F.coalesce(paragraphs, none), F.coalesce(lines, none), *[runs(n) for n in sorted(firsts)]), lambda u: u["unit"] != "")


def known_digests(spark: SparkSession, known=KNOWN + FULL) -> DataFrame:
    """(license_id, digest, n_paragraphs, first) of the known texts, distinct; a digest that two licences claim is given to both.

    `known` has (license_id, license_text), as pairs or as a DataFrame.
    """
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license_id string, license_text string")
    canon = table.select("license_id", canonical(F.col("license_text")).alias("_canon"))
    parts = _paragraphs(F.col("_canon"))
    return canon.select("license_id", F.sha2(F.regexp_replace("_canon", r"\n+", " "), 256).alias("digest"), F.size(parts).alias("n_paragraphs"), F.xxhash64(parts[0]).alias("first")).distinct()


def scan_licenses(docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document, licence and scope found: id, license_id, scope (text, paragraph, run or line), n.

    Up to BROADCAST_DIGESTS digests are broadcast, more are joined by a shuffle; what starts the known texts of several
    paragraphs comes to the driver. A run within a longer one that is known too counts as well.
    A null or empty text has no unit and no row; repeated rows of an id add up; a null id is a group of its own; further
    columns of `docs` are left out, an empty table gives an empty result.
    """
    firsts: dict[int, list[int]] = {}
    for r in digests.filter("n_paragraphs > 1").select("n_paragraphs", "first").distinct().collect():
        firsts.setdefault(r["n_paragraphs"], []).append(r["first"])
    canon = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("_canon")).select(id_col, "_canon", _paragraphs(F.col("_canon")).alias("_parts"))
    units = canon.select(id_col, F.explode(_units("_canon", "_parts", firsts)).alias("_u"))
    names = digests.select("license_id", "digest").distinct()
    names = F.broadcast(names) if names.count() <= BROADCAST_DIGESTS else names
    found = units.select(id_col, "_u.scope", F.sha2("_u.unit", 256).alias("_digest")).join(names, F.col("_digest") == F.col("digest"))
    return found.groupBy(id_col, "license_id", "scope").agg(F.count(F.lit(1)).alias("n"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document: its licences (code point order, comma-joined, empty if none) and the entire texts that name them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan_licenses(docs, known_digests(spark)).groupBy(F.col("doc_id").alias("_id")).agg(
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("_licenses"), F.sum("n").alias("_n"), F.max(F.col("scope") == "text").alias("_whole")
    )
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        F.coalesce("_licenses", F.lit("")).alias("licenses"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_found"),
        F.coalesce("_whole", F.lit(False)).alias("whole_text"),
    )


def _sql_canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, by in _steps(SQL_COPYRIGHT_LINE, SQL_GAP):
        by = by.replace("\n", "\\n")
        out = f"regexp_replace({out}, '{pattern}', {chr(39) + by + chr(39) if chr(92) not in by else 'chr(10)'}, 'g')"
    return out


def _oracle() -> str:
    known = ", ".join(f"('{i}', '{t.replace(chr(39), chr(39) * 2)}')" for i, t in KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT license_id, sha256(regexp_replace({_sql_canonical('t')}, '\\n+', ' ', 'g')) AS digest FROM (VALUES {known}) v(license_id, t)),
d AS (SELECT doc_id, {_sql_canonical('text')} AS c FROM documents),
u AS (SELECT doc_id, 'text' AS scope, regexp_replace(c, '\\n+', ' ', 'g') AS unit FROM d
  UNION ALL SELECT doc_id, 'paragraph', replace(unnest(regexp_split_to_array(c, '\\n\\n+')), chr(10), ' ') FROM d WHERE contains(c, chr(10) || chr(10))
  UNION ALL SELECT doc_id, 'line', unnest(regexp_split_to_array(c, '\\n+')) FROM d WHERE contains(c, chr(10))),
f AS (SELECT doc_id, license_id, scope, count(*) AS n FROM u JOIN k ON sha256(unit) = digest WHERE unit <> '' GROUP BY ALL),
a AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses, sum(n)::BIGINT AS n_found, bool_or(scope = 'text') AS whole_text FROM f GROUP BY ALL)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n_found, 0) AS n_found, coalesce(whole_text, false) AS whole_text
FROM documents d LEFT JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id"""


SQL = {"op8_license_scan": _oracle()}
