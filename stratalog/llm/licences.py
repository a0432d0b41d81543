"""Licence scan: whole texts, and single lines, by digest of their canonical form. DataFrame functions only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERMS_END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """The long licence texts beside this file, by SPDX name; those with an appendix on use also without it."""
    out = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out.append((path.stem, text))
        if TERMS_END in text:
            terms = text[: text.index(TERMS_END)]
            out += [(path.stem, terms + TERMS_END), (path.stem, terms)]
    return out


#: Notices and licence texts, by SPDX name.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    *whole_texts(),
]

#: Spellings that count as equal, as lower-case words with single spaces.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorise", "authorize"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("catalogue", "catalog"), ("centre", "center"), ("co operate", "cooperate"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("honour", "honor"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("sub license", "sublicense"), ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"), ("v", "version"), ("https", "http"),
]

#: Lines that only say who holds the rights.
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: What such a line holds; other texts need no search by line.
RIGHTS = ("copyright", "(c)", "©", "all rights reserved")
#: Characters that separate words, besides the space.
PUNCTUATION = "".join(map(chr, [*range(1, 32), *range(33, 48), *range(58, 97), *range(123, 128)])) + "©“”‘’–—\u00a0"
OTHER_SPELLING = " (" + "|".join(x for x, _ in SPELLINGS) + ") "
#: What each text of KNOWN holds; only the SQL looks for it, as a known table given by a user need not.
NOTICE = "licen|copyleft|public domain|redistribut"


def words_only(text: Column) -> Column:
    """Lower-case words between single spaces, without copyright lines; a space for a null or empty text."""
    out = F.lower(F.coalesce(text, F.lit("")))
    has_rights = out.contains(RIGHTS[0])
    for mark in RIGHTS[1:]:
        has_rights = has_rights | out.contains(mark)
    out = F.when(has_rights, F.regexp_replace(out, COPYRIGHT, "\n")).otherwise(out)
    out = F.translate(F.concat(F.lit(" "), out, F.lit(" ")), PUNCTUATION, " " * len(PUNCTUATION))
    return F.regexp_replace(out, " {2,}", " ")


def one_spelling(words: Column) -> Column:
    """Equivalent spellings as one; most texts hold none of them and stay as they are."""
    out = words
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.when(words.rlike(OTHER_SPELLING), out).otherwise(words)


def canonical(text: Column) -> Column:
    return one_spelling(words_only(text))


#: A table of known licences has at most this many digests; so it can be sent to every task.
MOST_KNOWN = 10_000


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """licence, digest: one row per digest (the first name by order, where two texts have one digest)."""
    listed = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("known_text")) for n, t in known])
    rows = spark.range(1, numPartitions=1).select(F.inline(listed))
    return rows.select("licence", F.sha2(canonical(F.col("known_text")), 256).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest of the whole canonical text, licence with that digest (or null), and notices: the sorted
    names whose known text is a whole line.

    A null text is empty: it has the digest of a single space and no licence. Repeated rows give repeated rows;
    extra columns are left out; an empty table gives no rows. More than MOST_KNOWN known digests are an error.
    """
    named = known.limit(MOST_KNOWN + 1).collect()
    if len(named) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known licences")
    names = F.create_map(*[F.lit(x) for row in named for x in (row["digest"], row["licence"])])
    words = F.transform(F.split("text", "\n"), words_only)
    licences = F.transform(words, lambda x: F.try_element_at(names, F.sha2(one_spelling(x), 256)))
    notices = F.array_sort(F.array_distinct(F.array_compact(licences)))
    out = docs.select("doc_id", words_only(F.col("text")).alias("words"), F.coalesce(F.concat_ws(",", notices), F.lit("")).alias("notices"))
    out = out.withColumn("digest", F.sha2(one_spelling(F.col("words")), 256))
    return out.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "licence", "notices")


def sql_canonical(text: str) -> str:
    """The same in DuckDB's SQL."""
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT}', chr(10), 'g')".replace("\\n", "\\x0A")
    marks = " || ".join(f"chr({ord(c)})" for c in PUNCTUATION)
    out = f"regexp_replace(translate(' ' || {out} || ' ', {marks}, repeat(' ', {len(PUNCTUATION)})), ' {{2,}}', ' ', 'g')"
    for other, one in SPELLINGS:
        out = f"replace({out}, ' {other} ', ' {one} ')"
    return out


def oracle_sql(known: list[tuple[str, str]] = KNOWN) -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known)
    return f"""
WITH listed AS (SELECT * FROM (VALUES {values}) AS v(licence, known_text)),
known AS (SELECT sha256({sql_canonical('known_text')}) AS digest, min(licence) AS licence FROM listed GROUP BY 1),
scanned AS (SELECT doc_id, text, sha256({sql_canonical('text')}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
noted AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM
  (SELECT doc_id, sha256({sql_canonical('line')}) AS digest FROM lines WHERE regexp_matches(lower(line), '{NOTICE}')) JOIN known USING (digest) GROUP BY 1)
SELECT doc_id, digest, licence, coalesce(notices, '') AS notices FROM scanned LEFT JOIN known USING (digest) LEFT JOIN noted USING (doc_id)
"""
