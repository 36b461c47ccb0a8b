"""Licence scan: canonical digests of whole texts, joined to known licences.

A document is looked at as a whole, in paragraphs (parted by empty lines) and in
lines. Each such text is brought to canonical form (lower case, copyright lines
removed, punctuation and white space as one space, equivalent spellings as one)
and its SHA-256 is joined to the digests of known licence texts and notices. All
work is done by built-in SQL functions.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that mean the same in a licence, after punctuation is gone.
EQUIVALENT = [
    ("acknowledgment", "acknowledgement"),
    ("analogue", "analog"),
    ("analyze", "analyse"),
    ("artifact", "artefact"),
    ("authorization", "authorisation"),
    ("authorized", "authorised"),
    ("caliber", "calibre"),
    ("canceled", "cancelled"),
    ("catalog", "catalogue"),
    ("center", "centre"),
    ("copyright owner", "copyright holder"),
    ("favor", "favour"),
    ("favorite", "favourite"),
    ("fulfil", "fulfill"),
    ("initialize", "initialise"),
    ("judgment", "judgement"),
    ("labeling", "labelling"),
    ("license", "licence"),
    ("licensed", "licenced"),
    ("merchantability", "merchantibility"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organization", "organisation"),
    ("organize", "organise"),
    ("percent", "per cent"),
    ("practice", "practise"),
    ("program", "programme"),
    ("realize", "realise"),
    ("recognize", "recognise"),
    ("sublicense", "sub license"),
    ("sublicense", "sub licence"),
    ("utilization", "utilisation"),
    ("while", "whilst"),
    ("version", "ver"),
    ("version", "v"),
]

# Notices that stand in one line.
NOTICES = [
    ("0BSD", "Licensed under the Zero-Clause BSD License."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("Unlicense", "Released under the Unlicense."),
]

# Whole licences.
MIT = """MIT License

Copyright (c) the authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """ISC License

Copyright (c) the authors

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

TEXTS = [
    ("MIT", MIT),
    ("ISC", ISC),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) the authors\n\n{BSD_TERMS}\n\n{BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) the authors\n\n{BSD_TERMS}\n\n{BSD_NAMES}\n\n{BSD_DISCLAIMER}"),
]

# The headings that a text goes by; it is known under each of them and under none.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License",
                     "Modified BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# Long texts are files of licence_texts; where the body of each begins, and where what may follow it does.
FILES = {
    "Apache-2.0": ("1. Definitions.", "END OF TERMS AND CONDITIONS"),
    "GPL-2.0": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "GPL-3.0": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "LGPL-2.1": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "LGPL-3.0": ("This version of the GNU Lesser", None),
    "MPL-2.0": ("1. Definitions", "Exhibit A - Source Code Form"),
    "Unlicense": ("This is free and unencumbered", None),
}
# A text whose paragraphs are all in another's too: copies of the other are none of it.
WITHIN = {"BSD-3-Clause": "BSD-2-Clause"}
PARAGRAPHS = r"\n[ \t\r]*\n\s*"


def bodies() -> list[tuple[str, str]]:
    """(licence, text) of each whole licence, without heading, copyright lines on top, and appendix."""
    out = [(name, text.split("\n\n", 2)[2]) for name, text in TEXTS]
    granted, disclaimed = dict(out)["ISC"].split("\n\n")
    out.append(("0BSD", granted[:granted.index(",\nprovided that")] + ".\n\n" + disclaimed))
    for name, (first, end) in FILES.items():
        text = _file(name)
        out.append((name, text[text.index(first):text.rindex(end) if end else None].strip()))
    return out


def _file(name: str) -> str:
    with open(os.path.join(os.path.dirname(__file__), "licence_texts", f"{name}.txt"), encoding="utf-8") as f:
        return f.read()


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the whole licences in all their forms: with each heading and none, files with and without appendix."""
    out = [(name, f"{heading}\n\n{text}") for name, text in bodies() for heading in ["", *HEADINGS.get(name, [])]]
    for name, (_, end) in FILES.items():
        text = _file(name)
        out.append((name, text))
        if end:
            cut = text.rindex(end)
            out += [(name, text[:cut]), (name, text[:cut] + (end if end.startswith("END") else ""))]
    return out


# Patterns of the canonical form, in the order they are applied to lower-case text.
# A copyright line names a sign, a year or "by" after the word, or ends with a year; a line of running text that
# a wrapping begins with the word ("copyright holders be liable") does not, nor does an item (c) of a list.
COPYRIGHT_LINE = (
    r"(?m)^[ \t*#/;%>-]*(?:copyright[ \t]*(?:\(c\)|©|:|[12][0-9][0-9][0-9]\b|by\b)[^\n]*"
    r"|copyright[ \t][^\n]{1,80}[ ,][12][0-9][0-9][0-9][ \t.]*\r?"
    r"|\(c\)[ \t]*(?:copyright\b|[12][0-9][0-9][0-9]\b)[^\n]*|©[^\n]*)$")
RESERVED_LINE = r"(?m)^[ \t*#/;%>-]*all rights reserved[ \t.]*$"
PUNCTUATION = r"[^\p{L}\p{N}]+"


# Every known text holds one of these in lower case, whatever its spelling; others need no closer look.
HINTS = ("licen", "permission", "redistribution")


def canonical(text: Column) -> Column:
    """Canonical form of a text; empty if nothing but copyright lines and punctuation is there."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, RESERVED_LINE, "")
    # Single words are replaced between spaces, so each one keeps a space of its own on either side.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, PUNCTUATION, " ")), F.lit(" "))
    for kept, other in EQUIVALENT:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {kept} "))
    return F.trim(out)


def known_licences(spark: SparkSession) -> DataFrame:
    """licence, digest of the built-in texts and notices."""
    known = spark.createDataFrame(NOTICES + TEXTS + whole_texts(), "licence string, text string")
    return known.select("licence", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest")).distinct()


def known_bodies(spark: SparkSession) -> DataFrame:
    """licence, digest, size: the paragraphs of each whole licence's body, and how many it has."""
    known = spark.createDataFrame([*bodies()], "licence string, text string")
    parts = known.select("licence", F.explode(F.split("text", PARAGRAPHS)).alias("unit"))
    parts = parts.select("licence", canonical(F.col("unit")).alias("form")).where("form <> ''").select("licence", F.sha2(F.col("form").cast("binary"), 256).alias("digest")).distinct()
    return parts.join(parts.groupBy("licence").agg(F.count("*").alias("size")), "licence")


def _whole_bodies(digests: DataFrame) -> DataFrame:
    """doc_id, licence, n: the paragraphs of licences whose bodies are there as a whole, n of them."""
    same = digests.where("kind = 'paragraph'").join(F.broadcast(known_bodies(digests.sparkSession)), "digest")
    same = same.groupBy("doc_id", "licence", "size", "digest").agg(F.count("*").alias("copies"))
    whole = same.groupBy("doc_id", "licence", "size").agg(F.count("*").alias("found"), F.min("copies").alias("copies"))
    whole = whole.where("found = size").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(  # of a few licences
        F.struct("licence", F.struct("size", "copies")))).alias("whole"))
    for outer, inner in WITHIN.items():
        fewer = F.col(f"whole.`{inner}`.copies") - F.coalesce(F.col(f"whole.`{outer}`.copies"), F.lit(0))
        whole = whole.withColumn("whole", F.map_filter("whole", lambda k, v: (k != inner) | (fewer > 0)))
    return whole.select("doc_id", F.explode("whole").alias("licence", "v")).select(
        "doc_id", "licence", (F.col("v.size") * F.col("v.copies")).alias("n"))


def _hinted(text: Column, hints) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in hints])


def scan(docs: DataFrame, known: DataFrame | None = None, hints: tuple[str, ...] = HINTS) -> DataFrame:
    """doc_id, licence, whole_text, n_paragraphs, n_lines: a row per document and licence found.

    Pass other ``known`` licences (licence, digest) with their own ``hints``: lower-case
    strings one of which every spelling of a known text holds (("",) for none).
    whole_text says that the document is nothing but that licence; the counts
    say how many of its paragraphs and lines are. Where the body paragraphs of a
    built-in licence are all in a document that holds more, they are counted as
    its paragraphs. A document without any has no
    row, nor has a null or empty text. A null doc_id is carried, its rows are
    counted together; repeated rows add up. Other columns are ignored, whatever
    their names; an empty table gives an empty table.
    """
    # The built-in table has a fixed size, so each task gets a copy; another is joined as Spark finds best.
    own = known is None
    known = F.broadcast(known_licences(docs.sparkSession)) if own else known
    units = docs.where(_hinted(F.col("text"), hints)).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.concat(
        F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("unit"))),
        F.transform(F.split("text", PARAGRAPHS), lambda p: F.struct(F.lit("paragraph").alias("kind"), p.alias("unit"))),
        F.transform(F.split("text", "\n"), lambda p: F.struct(F.lit("line").alias("kind"), p.alias("unit"))),
    )).alias("part"))
    # Paragraphs of a known body need hold none of the strings, only the document does.
    hinted = _hinted(F.col("part.unit"), hints)
    units = units.where(hinted | (F.col("part.kind") == "paragraph") if own else hinted)
    form = canonical(F.col("part.unit"))
    digests = units.select("doc_id", "part.kind", F.sha2(form.cast("binary"), 256).alias("digest"))
    found = digests.join(known, "digest").select("doc_id", "licence", "kind", F.lit(1).cast("long").alias("n"))
    if own:
        found = found.unionByName(_whole_bodies(digests).select("doc_id", "licence", F.lit("body").alias("kind"), "n"))
    whole = F.max(F.col("kind") == "text")
    count = {k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("long") for k in ("paragraph", "line", "body")}
    return found.groupBy("doc_id", "licence").agg(
        whole.alias("whole_text"),
        (count["paragraph"] + F.when(whole, 0).otherwise(count["body"])).cast("long").alias("n_paragraphs"),
        count["line"].alias("n_lines"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """The scan of ``documents`` in DuckDB's SQL."""
    steps = f"regexp_replace(lower(unit), {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    steps = f"regexp_replace({steps}, {_quoted(RESERVED_LINE)}, '', 'g')"
    steps = f"' ' || trim(regexp_replace({steps}, {_quoted(PUNCTUATION)}, ' ', 'g')) || ' '"
    for kept, other in EQUIVALENT:
        steps = f"replace({steps}, ' {other} ', ' {kept} ')"
    rows = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in NOTICES + TEXTS)
    return f"""
WITH known AS (SELECT DISTINCT licence, sha256(trim({steps})) AS digest FROM (VALUES {rows}) AS k(licence, unit)),
units AS (
  SELECT doc_id, 'text' AS kind, text AS unit FROM documents
  UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*')) FROM documents
  UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents),
digests AS (SELECT doc_id, kind, sha256(trim({steps})) AS digest FROM units WHERE unit IS NOT NULL)
SELECT doc_id, licence, bool_or(kind = 'text') AS whole_text,
       CAST(count(*) FILTER (WHERE kind = 'paragraph') AS BIGINT) AS n_paragraphs,
       CAST(count(*) FILTER (WHERE kind = 'line') AS BIGINT) AS n_lines
FROM digests JOIN known USING (digest) GROUP BY doc_id, licence"""
