"""Licence scan by canonical digests (DataFrame functions only).

A text is reduced to a canonical form: copyright lines go (those that begin with "copyright" and a sign
or year, with (c) and a year, or with the sign, and "all rights reserved"; so a licence keeps its digest
however it is wrapped), case, punctuation and white space are
levelled, and equivalent spellings become one. The SHA-256 of that form is looked up in the digests
of known licences by a hash join, for the entire text and for each of its lines; nothing partial
matches.

Defined results: null and blank texts have no digest match. Rows are judged one by one, repeated
rows and null ids included. Empty tables give empty results. Whole texts are read. Other columns stay;
one that is named as an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carrying, settle

#: Equivalent spellings (fixed values), applied to canonical text in this order.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("noncommercial", "non commercial"), ("copyright owner", "copyright holder"), ("whilst", "while"), ("v 2", "version 2"), ("v 3", "version 3"))

#: Known licences and notices (fixed values).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_3 = BSD_2.replace("THIS SOFTWARE IS PROVIDED BY", BSD_3_CLAUSE + "THIS SOFTWARE IS PROVIDED BY")
ZERO_BSD = ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_3),
    ("0BSD", ZERO_BSD),
    ("BSL-1.0", BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + BOOST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)

_STEPS = (
    # copyright lines: a mark or a year is needed, so that prose wrapped before "copyright" stays
    ("(?m)^[^\\p{L}\\p{N}\n]*(?i:copyright[^\\p{L}\\p{N}\n]*(?:\\(c\\)|©|[0-9]{4})|\\(c\\)[^\\p{L}\\p{N}\n]*(?:copyright|[0-9]{4})|©|all rights reserved[^\\p{L}\\p{N}\n]*$)[^\n]*$", " "),
    # punctuation and white space
    ("[^\\p{L}\\p{N}]+", " "),
)


def canonical(text: Column) -> Column:
    """The canonical form: lower case, words only, one space between them, standard spellings."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in _STEPS:
        out = F.regexp_replace(out, pattern, to)
    out = F.concat(F.lit(" "), F.trim(F.lower(out)), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if nothing is left of the text."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known(spark: SparkSession, licences=KNOWN) -> DataFrame:
    """(digest, licence), one row per digest; as many rows as licences were given."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("licence"), F.lit(b).alias("text")) for a, b in licences])))
    return rows.select(digest(F.col("text")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


#: Up to this many known digests (about 100 bytes each) they are broadcast; beyond, Spark chooses.
BROADCAST_ROWS = 100_000


def scan(df: DataFrame, licences: DataFrame, text: str = "text") -> DataFrame:
    """Add ``digest`` and ``licence`` of the entire text, and ``line_licences``: an array of
    (line, licence) for each line that is a known notice by itself, in order.

    The lines' matches are brought back by the text's own SHA-256, once per distinct text, so rows
    need no key and only matching lines are shuffled. Canonical forms are settled, so that filters
    and joins on digests don't compute them again.
    """
    return carrying(df, [text], ["digest", "licence", "line_licences"], lambda rows: _scan(rows, licences, text))


def _scan(df: DataFrame, licences: DataFrame, text: str) -> DataFrame:
    small = licences.count() <= BROADCAST_ROWS
    side = F.broadcast(licences) if small else licences
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = settle(df.withColumn("_t", F.sha2(t, 256)).withColumn("_c", canonical(F.col(text))), "_t", "_c").withColumn("digest", F.when(F.col("_c") != "", F.sha2("_c", 256))).drop("_c")
    lines = df.select(F.sha2(t, 256).alias("_t"), F.posexplode(F.split(t, "\n")).alias("line", "_l")).where(F.length("_l") > 0)
    forms = settle(lines.select("_t", F.col("line").cast("long").alias("line"), canonical(F.col("_l")).alias("_c")), "_c").where(F.col("_c") != "")
    lines = forms.select("_t", "line", F.sha2("_c", 256).alias("digest"))
    hits = lines.join(side, "digest").select("_t", "line", "licence").distinct()
    per_text = hits.groupBy("_t").agg(F.sort_array(F.collect_list(F.struct("line", "licence"))).alias("line_licences"))
    whole = keyed.join(side.withColumnRenamed("licence", "_licence"), "digest", "left").withColumnRenamed("_licence", "licence")
    out = whole.join(per_text, "_t", "left").drop("_t")
    return out.withColumn("line_licences", F.coalesce("line_licences", F.array().cast("array<struct<line:bigint,licence:string>>")))


def _sql_canonical(x: str) -> str:
    out = f"coalesce({x}, '')"
    out = f"regexp_replace({out}, '(?m)^[^\\p{{L}}\\p{{N}}\\n]*(?i:copyright[^\\p{{L}}\\p{{N}}\\n]*(?:\\(c\\)|©|[0-9]{{4}})|\\(c\\)[^\\p{{L}}\\p{{N}}\\n]*(?:copyright|[0-9]{{4}})|©|all rights reserved[^\\p{{L}}\\p{{N}}\\n]*$)[^\\n]*$', ' ', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    out = f"' ' || trim(lower({out})) || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


def oracle() -> str:
    """DuckDB SQL for the registered query."""
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH k0(licence, t) AS (VALUES {values}),
k AS (SELECT sha256({_sql_canonical('t')}) AS digest, min(licence) AS licence FROM k0 GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, {_sql_canonical('text')} AS c FROM documents),
l AS (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM d),
m AS (SELECT l.rid, l.i, k.licence FROM l JOIN k ON sha256({_sql_canonical('l.line')}) = k.digest WHERE {_sql_canonical('l.line')} <> ''),
g AS (SELECT rid, count(*) AS n, string_agg(i || ':' || licence, ',' ORDER BY i) AS s FROM m GROUP BY rid)
SELECT d.doc_id, CASE WHEN d.c <> '' THEN sha256(d.c) END AS digest, k.licence, coalesce(g.n, 0)::BIGINT AS n_lines, coalesce(g.s, '') AS line_licences
FROM d LEFT JOIN k ON d.c <> '' AND sha256(d.c) = k.digest LEFT JOIN g ON g.rid = d.rid
"""
