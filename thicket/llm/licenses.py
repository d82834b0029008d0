"""Licence scan: canonical digests of entire texts, joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import cut, let, table, with_small

#: Spellings held to be equal, as (other, canonical); fixed values.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analog", "analogue"), ("analyze", "analyse"), ("artifact", "artefact"), ("authorization", "authorisation"),
    ("authorized", "authorised"), ("calibre", "caliber"), ("canceled", "cancelled"), ("catalog", "catalogue"), ("categorise", "categorize"),
    ("center", "centre"), ("emphasised", "emphasized"), ("favor", "favour"), ("favorite", "favourite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgment", "judgement"), ("labeling", "labelling"), ("labor", "labour"),
    ("license", "licence"), ("licensed", "licenced"), ("licenses", "licences"), ("licensing", "licencing"), ("maximize", "maximise"),
    ("modeled", "modelled"), ("modeling", "modelling"), ("noncommercial", "non commercial"), ("offense", "offence"), ("optimize", "optimise"),
    ("organization", "organisation"), ("organize", "organise"), ("practice", "practise"), ("program", "programme"), ("realize", "realise"),
    ("recognize", "recognise"), ("signaling", "signalling"), ("sublicense", "sub licence"), ("sublicence", "sub licence"), ("sub license", "sub licence"),
    ("utilization", "utilisation"), ("while", "whilst"), ("wilfull", "wilful"), ("copyright owner", "copyright holder"), ("http", "https"),
]

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Known texts as (licence, text): public licences in full, and the one-line notices that stand for one. Fixed values; more come by the `known` parameter.
KNOWN = [
    ("MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_TAIL),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


#: Patterns in order, each with what takes its place: copyright lines; the reservation of rights; list numbers; punctuation.
STEPS = [
    (r"(^|\n)[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|\(c\)[ \t]*[0-9<\[]|©)[^\n]*", "\n"),
    (r"all rights reserved\.?", " "),
    (r"(^|\n)[ \t]*([0-9]{1,2}[.)]|\([a-z0-9]\)|[*•-])[ \t]+", " "),
    (r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”‘’«»…–—]+", " "),
]
ANY_SPELLING = r"\b(" + "|".join(a for a, _ in SPELLINGS) + r")\b"


def canonical(text: Column) -> Column:
    """The canonical form: lower case; lines that state a copyright and "all rights reserved" dropped; list numbers, punctuation and space runs as one space; equal spellings as one. Null stays null."""
    t = F.lower(text)
    for pattern, to in STEPS:
        t = F.regexp_replace(t, pattern, to)

    def spelled(t: Column) -> Column:
        one = t
        for other, to in SPELLINGS:
            one = F.regexp_replace(one, rf"\b{other}\b", to)
        return F.when(t.rlike(ANY_SPELLING), one).otherwise(t)  # few texts need the single patterns

    return F.trim(let(t, spelled))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form in hex; null for null."""
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(known_digest, license_id) of known texts; of licences with the same canonical text the first by name."""
    k = spark.createDataFrame(known, "license_id string, text string")
    return k.groupBy(digest(F.col("text")).alias("known_digest")).agg(F.min("license_id").alias("license_id"))


def known_from(spark: SparkSession, path: str) -> DataFrame:
    """known_digests() of a folder of licence texts, one file each, named by the licence (`MIT.txt`)."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("license_id"), F.col("value").alias("text"))
    return files.groupBy(digest(F.col("text")).alias("known_digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, limit: int = 32 << 20) -> DataFrame:
    """Each row of docs with `digest` and `license_id`: that of the licence whose entire canonical text equals the row's, else null.

    Null texts have neither; an empty text has the digest of the empty string. Repeated rows are alike. known: as from known_digests(); it is broadcast if its rows hold at most `limit` bytes. Columns of docs named digest, license_id or known_digest give way.
    """
    d = docs.drop("digest", "license_id", "known_digest").withColumn("digest", digest(F.col("text")))
    known = cut(known if known is not None else known_digests(docs.sparkSession))
    return with_small(d, known, F.col("digest") == F.col("known_digest"), limit=limit).drop("known_digest")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document and the licence whose whole text it is."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def _sql(e: str) -> str:
    """The canonical form as DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    e = f"lower({e})"
    for pattern, to in STEPS:
        e = f"regexp_replace({e}, {quote(pattern)}, {'chr(10)' if to == chr(10) else quote(to)}, 'g')"
    for other, to in SPELLINGS:
        e = f"regexp_replace({e}, {quote(rf'\b{other}\b')}, {quote(to)}, 'g')"
    return f"trim({e}, ' ')"


ORACLE = f"""
WITH k(license_id, text) AS (VALUES {", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in KNOWN)}),
kd AS (SELECT sha256({_sql("text")}) AS known_digest, min(license_id) AS license_id FROM k GROUP BY 1)
SELECT d.doc_id, d.digest, kd.license_id, kd.license_id IS NOT NULL AS is_license
FROM (SELECT doc_id, sha256({_sql("text")}) AS digest FROM documents) d LEFT JOIN kd ON d.digest = kd.known_digest
"""
