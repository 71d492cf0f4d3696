"""License scan by canonical digest: whole texts, brought to one form, looked up by their digest.

The looked-up texts are the document itself and each of its lines, every one as an entire text: a license file is
found by the first, a license notice inside a document by the second.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import stored
from spanlake.operators.staging import once

# Spellings that count as equal (the first is replaced by the second; single words).
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("https", "http"), ("judgement", "judgment"),
    ("merchantability", "merchantability"), ("noncommercial", "nc"), ("organisation", "organization"), ("whilst", "while"),
    ("wilful", "willful"), ("©", "copyright"), ("v2", "2"), ("v3", "3"),
]

# Known license texts and notices, (license, whether it permits commercial reuse without copyleft, text).
KNOWN = [
    ("MIT", True, "Released under the MIT License."),
    ("MIT", True, "Licensed under the MIT License."),
    ("MIT", True, "MIT License"),
    ("MIT", True, """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", True, """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", True, "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", True, "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2.0", True, "Apache License Version 2.0"),
    ("BSD-3-Clause", True, "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", True, "Licensed under the BSD 2-Clause License."),
    ("Unlicense", True, "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", True, "Licensed under CC0 1.0."),
    ("CC-BY-4.0", True, "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", False, "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", False, "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", False, "Licensed under CC BY-NonCommercial 4.0."),
    ("CC-BY-ND-4.0", False, "Licensed under CC BY-ND 4.0."),
    ("GPL-2.0", False, "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", False, "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", False, "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", False, "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", False, "Licensed under the Mozilla Public License, version 2.0."),
    ("proprietary", False, "All rights reserved."),
    ("proprietary", False, "Proprietary and confidential."),
]



def whole_texts() -> list[tuple[str, bool, str]]:
    """Entire license texts of the file beside this one, each with and without its titles and what may follow it (appendix);
    the short ones also with 'All rights reserved.' after the copyright line."""
    out = []
    for x in json.loads(Path(__file__).with_name("license_texts.json").read_text(encoding="utf-8")):
        reserved = ["", "All rights reserved."] if x["license"] in RESERVED else [""]
        out += [(x["license"], x["permissive"], "\n\n".join(filter(None, (title, more, text, tail))))
                for title in ["", *x["titles"]] for more in reserved for text in x["texts"] for tail in x["tails"]]
    return out


#: Licenses under whose copyright line 'All rights reserved.' is usual.
RESERVED = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")
KNOWN += whole_texts()

# Words after 'copyright' where a line is part of a sentence, not a statement of the holder.
AFTER_COPYRIGHT = [
    "holder", "holders", "notice", "notices", "owner", "owners", "license", "licenses", "licence", "licences", "law", "laws", "treaty", "treaties", "act", "acts",
    "interest", "interests", "right", "rights", "protection", "statement", "statements", "infringement", "and", "or", "in", "on", "of", "to", "for", "is", "are", "as", "the",
]


def other_than(words: list[str]) -> str:
    """A pattern for any word but these, without looking ahead (the SQL engine's patterns can't)."""
    heads = sorted({w[0] for w in words if w})
    rest = "".join(f"|{c}{other_than([w[1:] for w in words if w[:1] == c])}" for c in heads)
    whole = rf"(?:[^{''.join(heads)} \t\n.,:;][^ \t\n.,:;]*{rest})"
    return whole if "" in words else whole + "?"


def _copyright_line() -> str:
    year = "(?:19|20)[0-9][0-9]"
    name = "(?:" + other_than(AFTER_COPYRIGHT)[:-1] + ")"
    signed = r"copyright[ \t:,]*(?:\(c\)|©)|(?:\(c\)|©)[ \t:,]*copyright|©"
    dated = rf"\(c\)[^\n.]{{0,60}}?{year}|copyright[ \t:,]+(?:{year}|[<\[{{(](?:yyyy|year))|copyright[ \t:,]+{name}[ \t,:;]+(?:[^\n.]{{0,60}}[^\n.0-9])?{year}"
    # Periods that don't end the statement: of an initial, inside a word, before 'and' or a bracket ('Inc. and others').
    on = r"[^\n.]*(?:[ \t.][a-z]\.|\.[^ \t\n]|\.[ \t]+(?:(?:and|or|&|et)[ \t]|[<(\[]))"
    end = r"(?:\.[ \t]+|\.?(?:\n|$))"
    return rf"(?md)^[ \t#*/;-]*(?:(?:{signed}|{dated})(?:{on}){{0,40}}[^\n.]*|copyright[ \t]+{name}(?:[ \t]+[^ \t\n.,:;]+){{0,2}}[ \t]*){end}"


#: Statements at the start of a line of who holds the copyright, up to the end of the sentence; they differ from work to work.  A statement
#: has the word and a sign or year, the sign, (c) and a year, or is the word with a name of up to three words alone on the line.
COPYRIGHT_LINE = _copyright_line()
BETWEEN_WORDS = r"[^\p{L}\p{N}©\n]+"


def canonical_lines(text: Column) -> Column:
    """One form for all ways to write a license text, line by line: lower case, no copyright statements, single spaces in
    place of punctuation and white space, one spelling.  Lines without a word are empty."""
    body = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(COPYRIGHT_LINE), F.lit(""))
    # Two spaces around each word, so that every replaced word has both of its own.
    out = F.concat(F.lit("  "), F.regexp_replace(body, F.lit(BETWEEN_WORDS), F.lit("  ")), F.lit("  "))
    out = F.replace(out, F.lit("\n"), F.lit("  \n  "))
    for old, new in SPELLINGS:
        if old != new:
            out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.split(F.regexp_replace(out, F.lit(" +"), F.lit(" ")), r" ?\n ?", -1)


def joined_lines(lines: Column) -> Column:
    """The form of a whole text from the forms of its lines."""
    return F.trim(F.regexp_replace(F.array_join(lines, " "), F.lit(" +"), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The form of a whole text; empty if nothing is left."""
    return joined_lines(canonical_lines(text))


def known_digests(spark: SparkSession, known: list[tuple[str, bool, str]] | None = None) -> DataFrame:
    """(digest, license, permissive): one row per canonical text; if two licenses share one, the smaller name."""
    rows = spark.createDataFrame(known or KNOWN, "license string, permissive boolean, text string")
    digests = rows.withColumn("digest", F.sha2(canonical(F.col("text")), 256))
    # A written table, so that Spark knows its size when it plans the join.
    return stored(digests.groupBy("digest").agg(F.min("license").alias("license"), F.min_by("permissive", "license").alias("permissive")), "licenses")


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Look up every document and every line of it among the ``known`` digests.

    One row per input row: id, ``text_digest`` (of the canonical document), ``text_license`` (the whole document is this
    license; else NULL), ``n_lines`` (lines with a word), ``n_license_lines``, ``licenses`` (sorted, joined by commas; empty if
    none), ``permissive`` (false if any found license is not; NULL if none was found).  NULL and blank texts have no
    lines and no license; repeated rows come back as often as they are there; other columns play no part.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.col(text_col).alias("_text"))
    rows = once(rows, lines=canonical_lines(F.col("_text"))).select("_id", "_key", "lines")
    forms = F.concat(F.array(F.struct(F.lit(True).alias("whole"), joined_lines(F.col("lines")).alias("form"))),
                     F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), F.trim(x).alias("form"))))
    pieces = rows.select("_id", "_key", F.explode(forms).alias("piece")).select("_id", "_key", "piece.whole", "piece.form")
    pieces = pieces.filter("whole or form <> ''").withColumn("digest", F.sha2("form", 256))
    found = pieces.join(known, "digest", "left")
    whole, line, hit = F.col("whole"), ~F.col("whole"), F.col("license").isNotNull()
    per_row = found.groupBy("_id", "_key").agg(
        F.count(F.when(whole, 1)).alias("_copies"),
        F.max(F.when(whole, F.col("digest"))).alias("text_digest"),
        F.max(F.when(whole & (F.col("form") != ""), F.col("license"))).alias("text_license"),
        F.count(F.when(line, 1)).alias("n_lines"),
        F.count(F.when(line & hit, 1)).alias("n_license_lines"),
        # As many entries as there are known licenses at most.
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("form") != "", F.col("license")))), ",").alias("licenses"),
        F.min(F.when(F.col("form") != "", F.col("permissive"))).alias("permissive"))
    per_one = per_row.withColumn("_one", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    each = lambda c: (F.col(c) / F.col("_copies")).cast("long").alias(c)
    return per_one.select(F.col("_id").alias(id_col), "text_digest", "text_license", each("n_lines"), each("n_license_lines"), "licenses", "permissive")
