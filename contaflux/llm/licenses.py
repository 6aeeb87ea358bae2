"""License scan by canonical digests.

A text is brought to a canonical form (lower case, without copyright lines, punctuation
and markup, with one spelling of words that licences spell differently), and the digest of
the whole of it is looked up among the digests of known licence texts by a hash join. The
same is done with each line that has a word of a known one-line notice, against these
notices, so that a notice inside other text is found too, but only as a whole line.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as one, as whole words. Fixed values.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("colour", "color"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("maximise", "maximize"), ("merchantibility", "merchantability"), ("modelled", "modeled"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Known licence texts. Fixed values; a caller can pass more.
TEXTS = [
    ("MIT", _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
]
#: Known notices of one line. Fixed values; a caller can pass more.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
#: Lines are told apart by words of the notices up to so many; with more every line is looked up.
MOST_WORDS = 500
#: So many notices are looked up in a constant map, more by a join.
MOST_MAPPED = 2_000
_COPYRIGHT = r"(?im)^[ \t/*#;-]*(?:copyright\b|\(c\)|©|all rights reserved\b).*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, runs of what is no letter or digit as one blank, one spelling each."""
    plain = F.lower(F.regexp_replace(text, _COPYRIGHT, " "))
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    # Blanks are doubled so that words that follow one another are both replaced.
    plain = F.replace(plain, F.lit(" "), F.lit("  "))
    for variant, one in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(plain, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(digest, license) of texts; of two with the same digest the first name in order."""
    rows = spark.createDataFrame(texts, "license string, text string")
    return rows.groupBy(digest(F.col("text")).alias("known")).agg(F.min("license").alias("license"))


def spelt(word: str) -> set[str]:
    """word and what a text may have in its place: the first words of the spellings that give it."""
    found, new = {word}, {word}
    while new:
        new = {variant.split()[0] for variant, one in SPELLINGS if new & set(one.split())} - found
        found |= new
    return found


def speaks(line: Column, notices: list[str]) -> Column:
    """Whether a line may equal one of the canonical notices: it has the longest word of one."""
    words = {s for n in notices for s in spelt(max(sorted(n.split()), key=len))}
    if len(words) > MOST_WORDS:
        return F.lit(True)
    return F.lower(line).rlike("|".join(sorted(words))) if words else F.lit(False)


def scan(docs: DataFrame, texts: list[tuple[str, str]] = TEXTS, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, digest, license (of the whole text, else null) and notices (sorted distinct
    licences of its one-line notices) of every row of docs.

    The digest of a null text is null, that of a text without letters or digits is the
    empty text's and never known; a notice without letters or digits is none. Repeated rows
    stay; other columns are left out. Both
    tables of known digests are as large as the lists passed and broadcast only up to
    some thousand entries.
    """
    spark = docs.sparkSession
    plain = spark.createDataFrame(notices, "license string, text string").select("license", "text", canonical(F.col("text")).alias("plain")).where("plain <> ''").collect()
    whole, lines = known(spark, texts), known(spark, [(r["license"], r["text"]) for r in plain])
    if len(texts) <= 10_000:
        whole = F.broadcast(whole)
    lines_of = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: speaks(x, [r["plain"] for r in plain]))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.array_distinct(F.transform(lines_of, digest)).alias("lines"))
    if len(notices) <= MOST_MAPPED:
        # Few notices are a constant of the plan, looked up where the row is: no row has to be found again.
        table = F.from_json(F.lit(json.dumps({r["known"]: r["license"] for r in lines.collect()})), "map<string,string>")
        found = F.filter(F.transform("lines", lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())
        rows = rows.withColumn("notices", F.array_sort(F.array_distinct(found)))
    else:
        # Rows with the same lines have the same notices: these arrays, not numbers of rows, are the key.
        sets = rows.where(F.size("lines") > 0).select("lines").distinct()
        side = lines.select(F.col("known").alias("d"), F.col("license").alias("notice"))
        found = sets.select("lines", F.explode("lines").alias("d")).join(side, "d").groupBy("lines").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
        rows = rows.join(found, "lines", "left")
    out = rows.join(whole, F.col("digest") == F.col("known"), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def _sql(text: str) -> str:
    plain = rf"lower(regexp_replace({text}, '(?im)^[ \t/*#;-]*(?:copyright\b|\(c\)|©|all rights reserved\b).*$', ' ', 'g'))"
    plain = rf"replace(' ' || trim(regexp_replace({plain}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ', ' ', '  ')"
    for variant, one in SPELLINGS:
        plain = f"replace({plain}, ' {variant.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
    return f"sha256(trim(regexp_replace({plain}, ' +', ' ', 'g')))"


def _values(texts: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in texts)


ORACLE = rf"""
WITH whole AS (SELECT {_sql("t")} AS d, min(n) AS license FROM (VALUES {_values(TEXTS)}) v(n, t) GROUP BY 1),
line AS (SELECT {_sql("t")} AS d, min(n) AS notice FROM (VALUES {_values(NOTICES)}) v(n, t) GROUP BY 1),
rows AS (SELECT row_number() OVER () AS row, doc_id, {_sql("text")} AS digest, text FROM documents),
spoken AS (SELECT row, {_sql("x")} AS d FROM (SELECT row, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM rows) WHERE regexp_matches(x, '(?i)licen[cs]e|licen[cs]ed|released under')),
found AS (SELECT row, list_sort(list(DISTINCT notice)) AS notices FROM spoken JOIN line USING (d) GROUP BY row)
SELECT doc_id, digest, license, coalesce(notices, CAST([] AS VARCHAR[])) AS notices
FROM rows LEFT JOIN whole ON digest = whole.d LEFT JOIN found USING (row)
"""
