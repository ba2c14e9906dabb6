"""Licence scan by canonical digest: whole texts and whole lines against known licences.

A text is brought to a canonical form: lower case, copyright lines taken out, punctuation
and white space reduced to single spaces, equivalent spellings made one.  The md5 of the
form of a whole document, and of each of its lines, is joined to the digests of the known
licence texts and notices.  DataFrame functions only; the known side is a small table that
Spark broadcasts by its own size rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.sources.files import materialized

#: Spellings that mean the same, applied to canonical words in this order.
EQUIVALENTS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("sub license", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"), ("whilst", "while"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("https", "http"),
)

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including '
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all "
    'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
    "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
    "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License."
)
#: Known licence texts and one-line notices (licence, text).  Fixed values.
KNOWN = (
    ("MIT", _PERMISSION),
    ("MIT", f"MIT License {_PERMISSION}"),
    ("MIT", f"The MIT License (MIT) {_PERMISSION}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", f"ISC License {_ISC}"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All rights reserved", "All rights reserved."),
)

#: A copyright line: years and holder, with or without a sign.
_COPYRIGHT = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*"
_BETWEEN = "[^a-z0-9]+"


def plain_form(lower: Column) -> Column:
    """A lower-case text without copyright lines, its words joined by single spaces."""
    marked = lower.contains("copyright") | lower.contains("(c)") | lower.contains("©")
    kept = F.when(marked, F.regexp_replace(lower, _COPYRIGHT, "\n")).otherwise(lower)
    return F.trim(F.regexp_replace(kept, _BETWEEN, " "))


def same_spelling(form: Column) -> Column:
    for a, b in EQUIVALENTS:
        form = F.regexp_replace(form, rf"\b{a}\b", b)
    return form


def canonical(text: Column) -> Column:
    """Canonical form of a text; what is left empty is ''."""
    return same_spelling(plain_form(F.lower(text)))


def licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document, licence and scope: (doc_id, license, scope, n).

    ``scope`` is ``document`` when the whole text is a known licence and ``line`` when
    whole lines are; ``n`` counts them.  Null and empty texts have no licence; rows of one
    doc_id, null too, count together; columns other than doc_id and text are not read.
    ``known`` is a table (license, text) in place of the built-in one.
    """
    if known is None:
        pairs = F.array(*(F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in KNOWN))
        known = docs.sparkSession.range(1).select(F.inline(pairs))
    forms = known.where("text is not null").select("license", canonical(F.col("text")).alias("form"))
    forms = materialized(forms, "licenses")
    # spelling takes less than half of a word away, so longer forms than this match nothing
    longest = 2 * (forms.agg(F.max(F.length("form"))).first()[0] or 0)
    digests = forms.groupBy(F.md5("form").alias("digest")).agg(F.min("license").alias("license"))
    text = F.col("text").cast("string")
    lines = F.split("text", r"[\r\n]+")
    # a text of one line is a document, not a line of one
    bodies = F.concat(F.array("text"), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")))
    lowered = F.transform(bodies, lambda x: F.lower(x))
    formed = F.transform(lowered, lambda x: plain_form(x))
    units = docs.select("doc_id", text.alias("text")).select("doc_id", F.posexplode_outer(formed).alias("place", "form"))
    scope = F.when(F.col("place") == 0, "document").otherwise("line")
    short = units.where(F.length("form").between(1, longest)).select("doc_id", scope.alias("scope"), "form")
    found = short.withColumn("digest", F.md5(same_spelling(F.col("form")))).join(digests, "digest")
    return found.groupBy("doc_id", "license", "scope").agg(F.count("*").alias("n"))


def _sql_form(column: str) -> str:
    form = f"regexp_replace(lower({column}), '{_COPYRIGHT}', chr(10), 'g')"
    form = f"trim(regexp_replace({form}, '{_BETWEEN}', ' ', 'g'))"
    for a, b in EQUIVALENTS:
        form = rf"regexp_replace({form}, '\b{a}\b', '{b}', 'g')"
    return form


def _values() -> str:
    return ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)


ORACLE = rf"""
WITH known(license, body) AS (VALUES {_values()}),
digests AS (SELECT md5({_sql_form("body")}) AS digest, min(license) AS license FROM known GROUP BY ALL),
units AS (
  SELECT doc_id, 'document' AS scope, text AS body FROM documents
  UNION ALL
  SELECT doc_id, 'line', unnest(lines) FROM (
    SELECT doc_id, regexp_split_to_array(text, '[\r\n]+') AS lines FROM documents WHERE text <> '') WHERE len(lines) > 1),
forms AS (SELECT doc_id, scope, {_sql_form("body")} AS form FROM units)
SELECT doc_id, license, scope, count(*) AS n
FROM forms JOIN digests ON md5(form) = digest WHERE form <> '' GROUP BY ALL
"""
