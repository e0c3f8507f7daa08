"""Licence texts by canonical digest.

A text's canonical form has lower-case words alone: no punctuation, no copyright lines,
one spelling for words that are spelt in several ways. Its digest is joined with those of
known licences, for the whole text and for every line, as notices stand on their own line.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, bound, row_key, texts, words_of

#: Fixed value: words are what holds no ASCII sign other than letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lines that name a holder or reserve rights, after lower-casing.
COPYRIGHT = (
    r"^[^a-z0-9\x80-\x{10FFFF}]*((copyright|\(c\))[^a-z0-9]*(\(c\)|[0-9]{4}|<year>|\[yyyy\]|by )"
    r"|copyright \(c\)|©|all rights reserved)"
)
#: Spellings that count as the same word.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "catalogue": "catalog",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "licencing": "licensing",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "owner": "holder",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
#: Licences and notices as published, with their short names.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License
Copyright (c) <year> <copyright holders>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License
Copyright (c) <year> <owner>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Copyright [yyyy] [name of copyright owner]
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: Whole texts (a file's name begins with the licence's) and the ids of SPDX lines.
FOLDER = Path(__file__).with_name("known_licenses")
#: What follows these lines is advice on use, which copies often leave out.
ADVICE = re.compile(r"(?m)^.*END OF TERMS AND CONDITIONS.*$")
NUMBERS = re.compile(r"(?m)^\s*[0-9]\.\s+")
SUFFIXES = re.compile(r"(-only|-or-later|\+)$")


def forms(text: str) -> set[str]:
    """The text as it is; without the advice after its end; without the numbers of a
    short list."""
    end = ADVICE.search(text)
    out = {text} if end is None else {text, text[: end.end()], text[: end.start()]}
    return out if len(text) > 4000 else out | {NUMBERS.sub("", x) for x in out}


def whole_texts() -> list[tuple[str, str]]:
    """Every form of the licences in FOLDER, with and without a line that names them."""
    out = []
    for path in sorted(FOLDER.glob("*.txt")):
        name = re.match(r"[A-Za-z]+[0-9]*(-[0-9]+\.[0-9]+|-[0-9]-Clause)?", path.name)[0]
        for form in sorted(forms(path.read_text(encoding="utf-8"))):
            out.append((name, form))
            if name.startswith("BSD"):
                out.append((name, f"{name} License\n{form}"))
    return out


def spdx_lines() -> list[tuple[str, str]]:
    """An SPDX line for every id; the versions `only` and `or later` are one licence."""
    ids = (FOLDER / "spdx_ids").read_text(encoding="utf-8").split()
    return [(SUFFIXES.sub("", x), f"SPDX-License-Identifier: {x}") for x in ids]


#: Notices, whole texts and SPDX lines, with their licences' short names.
KNOWN = (*NOTICES, *whole_texts(), *spdx_lines())
#: Known digests up to which they are broadcast (about 100 bytes each).
BROADCAST_KNOWN = 200_000


def canonical_lines(text: Column) -> Column:
    """The canonical form of every line that is not a copyright line and has words."""

    def canonical(line: Column) -> Column:
        spelt = F.transform(words_of(line, WORD), one_spelling)
        return F.array_join(spelt, " ")

    lines = F.filter(F.split(ascii_lower(text), "\n"), lambda x: ~x.rlike(COPYRIGHT))
    return F.filter(F.transform(lines, canonical), lambda x: x != "")


def one_spelling(word: Column) -> Column:
    case = F
    for other, same in SPELLINGS.items():
        case = case.when(word == other, F.lit(same))
    return F.when(F.char_length(word) < 5, word).otherwise(case.otherwise(word))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest and license_id; of several names for one digest the first in the alphabet."""
    if known is None:
        known = spark.createDataFrame(KNOWN, "license_id string, text string").coalesce(1)
    lines = F.array_join(canonical_lines(F.col("text")), " ")
    digests = (
        known.select("license_id", digest(lines).alias("digest"))
        .groupBy("digest")
        .agg(F.min("license_id").alias("license_id"))
    )
    return F.broadcast(digests) if known.count() <= BROADCAST_KNOWN else digests


def license_scan(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the whole text), notices and n_notices (of lines).

    `notices` lists the different licences of lines in alphabetical order; `n_notices`
    counts those lines. A text without words outside copyright lines, a NULL one too, has
    no digest and no licence. Repeated rows get the same result; a NULL doc_id stays.
    Other columns are not read. `known` has license_id and text; KNOWN by default.
    """
    digests = known_digests(spark, known)
    rows = texts(docs)
    key = ["key_a", "key_b"]
    notices = rows.select(
        *row_key("doc_id", "text"), F.posexplode(canonical_lines(F.col("text"))).alias("at", "line")
    )
    found = (
        notices.select(*key, "at", digest(F.col("line")).alias("digest"))
        .join(digests, "digest")
        .groupBy(*key)
        .agg(
            F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"),
            F.count_distinct("at").alias("n_notices"),
        )
    )
    whole = rows.select(
        *row_key("doc_id", "text"),
        "doc_id",
        bound(
            F.array_join(canonical_lines(F.col("text")), " "),
            lambda c: F.when(c != "", digest(c)),
        ).alias("digest"),
    )
    return (
        whole.join(digests, "digest", "left")
        .join(found, key, "left")
        .select(
            "doc_id",
            "digest",
            "license_id",
            F.coalesce("notices", F.lit("")).alias("notices"),
            F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        )
    )


def oracle_sql() -> str:
    """The same scan of `documents` in SQL."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    known = ",\n".join(f"({text(name)}, {text(body)})" for name, body in KNOWN)
    spelt = " ".join(f"WHEN {text(a)} THEN {text(b)}" for a, b in SPELLINGS.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    lines = f"""list_filter(list_transform(
        list_filter(string_split({lower}, chr(10)), lambda x: NOT regexp_matches(x, {text(COPYRIGHT)})),
        lambda x: array_to_string(list_transform(regexp_extract_all(x, {text(WORD)}),
            lambda w: CASE w {spelt} ELSE w END), ' ')), lambda x: x <> '')"""
    return f"""
WITH known(license_id, text) AS (VALUES {known}),
digests AS (
    SELECT sha256(array_to_string({lines}, ' ')) AS digest, min(license_id) AS license_id
    FROM known GROUP BY 1
), docs AS (
    SELECT doc_id, {lines} AS lines FROM documents
), found AS (
    SELECT doc_id, license_id FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM docs)
    JOIN digests USING (digest)
), notices AS (
    SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices,
           count(*) AS n_notices FROM found GROUP BY doc_id
), whole AS (
    SELECT doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS digest
    FROM docs
)
SELECT w.doc_id, w.digest, d.license_id, coalesce(n.notices, '') AS notices,
       CAST(coalesce(n.n_notices, 0) AS BIGINT) AS n_notices
FROM whole w LEFT JOIN digests d ON w.digest = d.digest LEFT JOIN notices n ON w.doc_id = n.doc_id
"""
