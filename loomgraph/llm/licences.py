"""Licence scans (7): whole texts and whole lines looked up among canonical licence digests.

A text is made canonical: lower case, copyright lines left out, one spelling
for words that have several, and everything but letters and digits read as one
space. The digest of the result is joined to the digests of known licences; the
same is done for every line, which finds notices inside longer documents.

Defined cases: null, empty and blank texts match nothing; a line that is left
out as a copyright line matches nothing; identical rows are looked up alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.text import whole

# Spellings that count as the same, from the public matching guidelines for licences.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Texts of licences and of the notices that name them.
LICENCES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
# How many lines with words at the top of a text are its title; texts of the folder are read beside those above.
TITLES = {
    "Apache-2.0": 3, "BSD-2-Clause": 1, "BSD-3-Clause": 1, "CC0-1.0": 2, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.0": 2,
    "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-1.1": 2, "MPL-2.0": 1, "Unlicense": 1,
}
HEADS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "BSD-2-Clause": ["The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["The BSD 3-Clause License", "BSD License", "New BSD License"],
}
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
}


# Words that follow "copyright" where a sentence of a licence runs over a line's end; other such lines are copyright lines.
_RUNNING = "(?:also|and|holders?|in|interests?|laws?|license|line|notices?|on|or|owners?|statements?|to)\\b"


def licence_texts() -> list[tuple[str, str]]:
    """``text, licence`` of every known whole text: with its usual titles and without, with the advice behind its terms and without."""
    texts = dict(LICENCES)
    for name in TITLES:
        texts[name] = (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text(encoding="utf-8")
    out = []
    for name, text in texts.items():
        lines = [line for line in text.splitlines() if any(c.isalnum() for c in line)]
        last = [i for i, line in enumerate(lines) if line.strip() == "END OF TERMS AND CONDITIONS"]
        for body in (lines, *([lines[: last[0] + 1], lines[: last[0]]] if last else [])):
            bare = body[TITLES.get(name, 0) :]
            out += [("\n".join(found), name) for found in (body, bare, *([head, *bare] for head in HEADS.get(name, [])))]
    return out


def canonical_lines(text: Column) -> Column:
    """The text with every line canonical, each between two spaces; copyright lines are empty."""
    line = F.regexp_replace(F.lower(whole(text)), r"[^\p{L}\p{N}\n]+", " ")
    line = F.regexp_replace(line, r"(?m)^ ?(?:copyright(?: (?!" + _RUNNING + r")|$)|c \p{N}{4}|all rights reserved ?$)[^\n]*", "")
    line = F.concat(F.lit(" "), F.replace(line, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for other, usual in SPELLINGS:
        line = F.replace(line, F.lit(f" {other} "), F.lit(f" {usual} "))
    return line


def canonical(lines: Column) -> Column:
    """One text of canonical lines, on one line."""
    return F.trim(F.regexp_replace(lines, r"\s+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, licence`` of the known texts, a parameter; of texts with one digest the first counts."""
    rows = known if known is not None else licence_texts() + list(NOTICES.items())
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, text string, licence string")
    digest = F.sha2(canonical(canonical_lines(F.col("text"))), 256)
    return table.groupBy(digest.alias("digest")).agg(F.min_by("licence", "i").alias("licence"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``_own`` (all columns), ``licence`` of the whole text and ``notices``, the licences of whole lines, sorted and distinct.

    The known digests are as many as the list given, and are broadcast; texts are not shuffled.
    """
    digests = known_digests(docs.sparkSession, known)
    one = digests.agg(F.map_from_entries(F.collect_list(F.struct("digest", "licence"))).alias("map"))
    table = F.create_map(*[F.lit(v) for row in one.toLocalIterator() for pair in row.map.items() for v in pair]) if known != [] else F.create_map()
    lines = docs.select(F.struct("*").alias("_own"), canonical_lines(F.col("text")).alias("_lines"))
    whole_text = canonical(F.col("_lines"))
    digest = F.when(whole_text != "", F.sha2(whole_text, 256))
    each = F.transform(F.split("_lines", "\n"), lambda line: F.sha2(F.trim(F.regexp_replace(line, " +", " ")), 256))
    names = F.transform(each, lambda d: F.element_at(table, d))
    notices = F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull())))
    found = lines.withColumn("digest", digest).join(F.broadcast(digests), "digest", "left")
    return found.select("_own", "licence", notices.alias("notices"))
