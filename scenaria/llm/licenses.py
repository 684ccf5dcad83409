"""Licence scan by canonical digests of whole texts.

A text's canonical form: A-Z lowered, copyright lines left out, typographic quotes and dashes made plain, http and
https alike, punctuation and white space runs turned into one space, equivalent spellings made one. Its SHA-256 is
hash-joined to the digests of the known licences; a match means that the whole text is that licence up to those
differences. The same is done for each line of a text, so that a licence notice of one line inside a longer text
is found too.

The known licences are the notices below and, by digest, the full texts in ``license_digests.csv`` (with and without the
parts after the terms). Lines are digested only where they hold one of the signs: of each known text a word that its
canonical form cannot do without.

A null or blank text has the empty canonical form and matches nothing. Repeated rows are judged each. If two known
texts are canonically equal, the smaller licence id is given.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenaria.llm.common import id_text

#: Known notices and short licences (public texts).
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
]
#: Equivalent spellings, as words of the canonical form.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"),
             ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("analogue", "analog"), ("favour", "favor"),
             ("noncommercial", "non commercial"), ("noninfringement", "non infringement"), ("whilst", "while"), ("v2", "version 2"), ("v3", "version 3")]
#: A line that opens with a copyright mark and names a year or a holder.
COPYRIGHT = r"(?m)^[ \t>*/#-]*(?:[Cc]opyright|COPYRIGHT|\([cC]\)|©)[ \t]*(?:\([cC]\)|©|[Cc]opyright|[0-9]{4})[^\n]*$"

#: Everything but ASCII letters, digits and other scripts' characters; typographic spaces, dashes, quotes and bullets too.
MARKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F\u00a0\u2010-\u2015\u2018-\u201f\u2022]+"
#: Full texts by digest: license_id, digest, sign.
FULL = Path(__file__).with_name("license_digests.csv")
#: More signs than this are not searched for; every line is digested then.
MOST_SIGNS = 300


def canonical(text: Column) -> Column:
    t = F.regexp_replace(text, COPYRIGHT, " ")
    t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(t, "https://", "http://")
    t = F.regexp_replace(t, "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F ‐-―‘-‟•]+", " ")
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def sign(canonical_text: Column) -> Column:
    """A word that every text of this canonical form holds as it stands, whatever the case; null if there is none."""
    made = sorted({w for _, b in SPELLINGS for w in b.split()})
    own = F.filter(F.split(canonical_text, " "), lambda w: ~w.isin(made) & (w != ""))
    return F.array_max(F.transform(own, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def license_ids(docs: DataFrame, known: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(doc_id, digest, license_id, line_licenses): the licence that a document's whole text is, null if none, and
    the licences that lines of it are, sorted and comma-joined (empty if none)."""
    spark = docs.sparkSession
    of_module = known is KNOWN
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame(known, "license_id string, text string")
    known = known.select("license_id", digest(F.col("text")).alias("digest"), sign(canonical(F.col("text"))).alias("sign"))
    if of_module:
        full = [tuple(x.split(",")) for x in FULL.read_text().splitlines()]
        known = known.unionByName(spark.createDataFrame(full, "license_id string, digest string, sign string"))
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256))  # a blank text is no licence
    table = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    signs = [r.sign for r in known.select("sign").distinct().limit(MOST_SIGNS + 1).collect()]
    holds = F.lit(True)
    if None not in signs and len(signs) <= MOST_SIGNS:
        holds = F.col("line").rlike("(?i)" + "|".join(sorted(map(re.escape, signs)))) if signs else F.lit(False)
    docs = id_text(docs)
    key = F.xxhash64("text").alias("text_key")
    # equal rows share one key, so repeated rows need no number of their own
    lines = (docs.select("doc_id", key, F.explode(F.split("text", "\n")).alias("line")).where(holds).select("doc_id", "text_key", digest(F.col("line")).alias("digest")))
    found = (lines.join(table, "digest").groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("k"))
             .agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses")))
    whole = docs.select("doc_id", key, digest(F.col("text")).alias("digest")).join(table, "digest", "left")
    return (whole.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("k")), "left")
            .select("doc_id", "digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses")))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_digest(text: str) -> str:
    t = f"regexp_replace({text}, {_sql_text(COPYRIGHT)}, ' ', 'g')"
    t = f"replace(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'https://', 'http://')"
    t = f"' ' || trim(regexp_replace({t}, {_sql_text(MARKS)}, ' ', 'g'), ' ') || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"sha256(trim({t}, ' '))"


def oracle_sql() -> str:
    """The same result over the view documents."""
    known = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)
    return f"""WITH known AS (SELECT min(id) AS license_id, {_sql_digest('text')} AS digest FROM (VALUES {known}) AS k(id, text) GROUP BY 2),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
found AS (SELECT r, string_agg(license_id, ',' ORDER BY license_id) AS line_licenses FROM
 (SELECT DISTINCT r, license_id FROM lines JOIN known ON {_sql_digest('line')} = known.digest) GROUP BY r)
SELECT doc_id, {_sql_digest('docs.text')} AS digest, license_id, coalesce(line_licenses, '') AS line_licenses
FROM docs LEFT JOIN known ON {_sql_digest('docs.text')} = known.digest LEFT JOIN found ON docs.r = found.r"""
