"""Licence scans by canonical digest lookup.

A text's canonical form has A-Z in lower case, copyright notices (lines, see NOTICE_LINE) taken out, ASCII
punctuation and white space as single spaces, and equivalent spellings made one. The SHA-256 of the whole canonical
text is looked up among the digests of known licence texts; the same holds line by line for known one-line notices.
All of it is column expressions; the table of known texts is fixed, so the lookup is a broadcast hash join.

Defined cases: a null text counts as empty; a text whose canonical form is empty has no licence; repeated rows are
looked up each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, whole
from .licence_texts import DIGESTS, MORE

#: Spellings taken as equal, each with a space on both sides of the word's beginning.
SPELLINGS = ((" licence", " license"), (" sub license", " sublicense"), (" organisation", " organization"), (" authorisation", " authorization"), (" non infringement", " noninfringement"), (" favour", " favor"), (" https ", " http "))

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Known whole texts (without title and copyright lines), and one-line notices.
TEXTS = (("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("BSD-2-Clause", _BSD2), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2))
#: With those that the SQL does not know.
ALL_TEXTS = TEXTS + MORE + tuple(("BSD-2-Clause", title + "All rights reserved.\n\n" + _BSD2) for title in ("", "BSD 2-Clause License\n\n"))
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
)
#: Of the SQL, which takes out every line that begins so; the query takes out notices only.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[^\n]*"
#: A sign or word and then a sign, a year, a blank to fill in or a holder; not the word in running text, nor a point (c) of a list.
_NO_HOLDER = r"[ \t]+(?:notices?|holders?|owners?|ownership|laws?|licen[cs]es?|licen[cs]ors?|statements?|interests?|treat(?:y|ies)|rights?|protection|infringements?|disclaimers?|permission|patents?|trademarks?|and|or|of|in|on|is|are|to|for|this|that|which|by this|as|under|with|shall|may|will|must)\b"
NOTICE_LINE = r"(^|\n)[ \t]*(?:copyright\b(?![ \t]*(?:\n|$))(?!" + _NO_HOLDER + r")|\(c\)[ \t]*(?:copyright\b|©|[12][0-9]{3})|©)[^\n]*"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def canonical(text: Column, lowered: bool = False) -> Column:
    """One space at either end."""
    plain = F.regexp_replace(F.regexp_replace(text if lowered else ascii_lower(text), NOTICE_LINE, "$1"), PUNCTUATION, " ")
    spaced = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), SPELLINGS, spaced)


def digest(text: Column, lowered: bool = False) -> Column:
    return F.sha2(canonical(text, lowered), 256)


def known(docs: DataFrame, texts: tuple = ALL_TEXTS, digests: tuple = ()) -> DataFrame:
    """licence, digest; of texts, and as given."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("t")) for n, t in texts]))
    found = docs.sparkSession.range(1).select(rows.alias("r")).select("r.licence", digest(F.col("r.t")).alias("digest"))
    if digests:
        given = F.explode(F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(d).alias("digest")) for n, d in digests]))
        found = found.unionByName(docs.sparkSession.range(1).select(given.alias("r")).select("r.licence", "r.digest"))
    return found.distinct()


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, digest (of the whole canonical text), licence (null if unknown), n_notices, notices (names, sorted, comma-joined)."""
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), ascii_lower(whole(text_col)).alias("_t"))
    notices = {r["digest"]: r["licence"] for r in known(docs, NOTICES).collect()}  # len(NOTICES) rows
    names = F.create_map(*[F.lit(x) for p in notices.items() for x in p])
    lines = F.filter(F.transform(F.split("_t", "\n", -1), lambda x: F.try_element_at(names, digest(x, lowered=True))), lambda x: x.isNotNull())
    rows = rows.select(id_col, digest(F.col("_t"), lowered=True).alias("digest"), lines.alias("_n"))
    found = rows.join(F.broadcast(known(docs, digests=DIGESTS)), "digest", "left")  # a row a known text
    return found.select(id_col, "digest", "licence", F.size("_n").cast("long").alias("n_notices"), F.concat_ws(",", F.array_sort(F.array_distinct("_n"))).alias("notices"))


def oracle(documents: str = "documents") -> str:
    """The same for DuckDB."""

    def form(t: str) -> str:
        x = f"' ' || trim(regexp_replace(regexp_replace({t}, '{COPYRIGHT_LINE}', '\\1', 'g'), '{PUNCTUATION}', ' ', 'g')) || ' '"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    low = lambda t: f"translate({t}, '{UPPER}', '{LOWER}')"
    rows = lambda texts: ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in texts)
    return f"""
WITH texts AS (SELECT DISTINCT n AS licence, sha256({form(low("t"))}) AS digest FROM (VALUES {rows(TEXTS)}) v(n, t)),
notes AS (SELECT DISTINCT n, sha256({form(low("t"))}) AS digest FROM (VALUES {rows(NOTICES)}) v(n, t)),
docs AS (SELECT doc_id, {low("coalesce(text, '')")} AS t FROM {documents}),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS t FROM docs),
found AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT n, ',' ORDER BY n) AS notices FROM lines JOIN notes ON sha256({form("t")}) = digest GROUP BY doc_id)
SELECT d.doc_id, sha256({form("d.t")}) AS digest, licence, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM docs d LEFT JOIN texts ON texts.digest = sha256({form("d.t")}) LEFT JOIN found USING (doc_id)"""
