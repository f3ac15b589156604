"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

DataFrame functions alone. Passages are a file's paragraphs, lines and runs of three lines that speak of a
licence, and all of such a file; signs that set comments off count for nothing. A licence file is one
named so, or one of which a matched passage holds half of the words or more. Files without a licence of
their own take that of the nearest directory above them, or their own, that has a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Licences and what they are called. Each is put into every frame.
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "Eclipse Public License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Unlicense", "Unlicense"),
)
FRAMES = ("Licensed under the {name}.", "Released under the {name}.", "This program is distributed under the terms of the {name}.", "SPDX-License-Identifier: {id}", "SPDX-License-Identifier: {id}-or-later", "{name}")

_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_LIABILITY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_GNU_NOTICE = "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
_GNU_TITLE = "GNU {name} Version {v}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU = (
    ("GPL-2.0", "General Public License", "2", "June 1991", "1989, 1991", "program"),
    ("GPL-3.0", "General Public License", "3", "29 June 2007", "2007", "program"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999", "1991, 1999", "library"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007", "2007", "library"),
    ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007", "2007", "program"),
)
#: Whole texts of short licences, and headers and openings of long ones.
TEXTS = (
    ("MIT", "MIT License Copyright (c) " + _MIT_GRANT + " " + _MIT_REST),
    ("MIT", _MIT_GRANT),
    ("BSD-2-Clause", "Copyright (c) All rights reserved. " + _BSD_GRANT + " " + _BSD_LIABILITY),
    ("BSD-3-Clause", "Copyright (c) All rights reserved. " + _BSD_GRANT + " " + _BSD_NAMES + " " + _BSD_LIABILITY),
    ("BSD-3-Clause", _BSD_NAMES),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain under CC0 1.0 Universal."),
    *((i, _GNU_NOTICE.format(thing=thing, name=name, v=v)) for i, name, v, _, _, thing in _GNU),
    *((i, _GNU_TITLE.format(name=name, v=v, date=date, year=year)) for i, name, v, date, year, _ in _GNU),
    ("proprietary", "All rights reserved."),
)
TEMPLATES = (*((i, frame.format(id=i, name=name)) for i, name in NAMES for frame in FRAMES), *TEXTS)
TRIGGER = r"(?i)licen[cs]e|copyright|spdx|all rights reserved|permission is hereby|permission to use|redistribution and use|public domain|free software"
#: Passages that deny a licence.
DENIED = r"(?i)\b(not|never|no longer)[ \t]+([a-z]+[ \t]+)?([a-z]+[ \t]+)?(licen[cs]ed|released|available|covered|offered)?[ \t]*under\b"
FILE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^notice"
#: What parts paragraphs: a line end and lines without letters and digits.
BETWEEN = r"\n([^A-Za-z0-9\n]*\n)+"
LEAST = 0.55
#: A file of whose words one matched passage has at least this share is a licence file.
COVERAGE = 0.5


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+", -1), "")


def weights(spark: SparkSession) -> DataFrame:
    """(template, license, term, weight, idf): the templates' unit vectors; a few thousand rows whatever the input."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "template int, license string, text string")
    tf = rows.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log(F.lit(1.0 + len(TEMPLATES)) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    both = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = both.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return both.join(norm, "template").select("template", "license", "term", (F.col("w") / F.col("norm")).alias("weight"), "idf")


def matches(passages: DataFrame) -> DataFrame:
    """(row, passage, template, license, cosine, evidence) of passages(row, passage, text): templates at cosine LEAST or more.

    Terms that no template has count with the rarest weight. Evidence is the cosine times the passage's own length,
    so that a long passage says more than a name in it.
    """
    known = cut(weights(passages.sparkSession))
    unknown = F.lit(1.0) * (F.log(F.lit(1.0 + len(TEMPLATES))) + 1.0)
    tf = passages.select("row", "passage", F.explode(_terms(F.col("text"))).alias("term")).groupBy("row", "passage", "term").agg(F.count("*").alias("tf"))
    # the templates' terms are a fixed list
    norms = tf.join(F.broadcast(known.select("term", "idf").distinct()), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unknown))
    norms = norms.groupBy("row", "passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(known), "term").groupBy("row", "passage", "template", "license").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    cosines = dots.join(norms, ["row", "passage"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
    return cosines.where(F.col("cosine") >= LEAST).select("row", "passage", "template", "license", "cosine", F.round("dot", 6).alias("evidence"))


def passages_of(text: str) -> Column:
    """The distinct passages of a text that speak of a licence: paragraphs, lines, lines with their neighbours, all of it; none that deny one."""
    lines = F.split(F.col(text), "\n", -1)
    speaks = lambda x: x.rlike(TRIGGER) & ~x.rlike(DENIED)
    around = lambda first: F.filter(F.transform(F.filter(F.transform(lines, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda s: s["x"].rlike(TRIGGER)), lambda s: F.array_join(F.slice(lines, F.greatest(s["k"] + first, F.lit(1)), F.lit(3)), " ")), speaks)
    return F.array_distinct(F.concat(F.filter(F.split(F.col(text), BETWEEN, -1), speaks), F.filter(lines, speaks), around(0), around(1), F.filter(F.array(F.col(text)), speaks)))


def scan(files: DataFrame) -> DataFrame:
    """license_of every row of files(path, text): path, license, cosine, origin ('own', 'inherited' or null), origin_dir.

    "All rights reserved" counts only where nothing else matches; else the match of most evidence, of equals the nearest, then the first template. Null text has
    no passages; a null path is a file in the root. Rows with one path are files of their own. An empty table gives no rows.
    """
    paths = files.select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    directory = F.when(F.instr("path", "/") > 0, F.expr("left(path, length(path) - locate('/', reverse(path)))")).otherwise("")
    named = F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME)
    # only texts that speak of licences leave passages
    speaks = F.col("text").rlike(TRIGGER)
    rows = cut(paths.select(F.monotonically_increasing_id().alias("row"), "path", directory.alias("dir"), named.alias("named"), F.when(speaks, F.size(_terms(F.col("text")))).alias("n_terms"), F.when(speaks, passages_of("text")).alias("passages")))
    passages = rows.select("row", F.posexplode("passages").alias("passage", "text"))
    found = cut(matches(passages))
    value = F.struct((F.col("license") != "proprietary").alias("names"), "evidence", "cosine", (-F.col("template")).alias("order"), "license")
    own = found.groupBy("row").agg(F.max(value).alias("best"))
    size = passages.select("row", "passage", F.size(_terms(F.col("text"))).alias("n")).join(found.select("row", "passage").distinct(), ["row", "passage"])
    own = cut(own.join(size.groupBy("row").agg(F.max("n").alias("n")), "row").select("row", "best", "n"))
    holders = rows.join(own, "row").where(F.col("named") | (F.col("n") >= COVERAGE * F.col("n_terms")))
    by_dir = cut(holders.groupBy("dir").agg(F.max("best").alias("best")).select("dir", "best.license"))
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    walks = rows.select("dir").distinct().select(F.col("dir").alias("of"), F.posexplode(above).alias("depth", "dir"))
    nearest = walks.join(by_dir, "dir").groupBy("of").agg(F.max_by(F.struct("license", "dir"), "depth").alias("near"))
    out = rows.select("row", "path", "dir").join(own.select("row", "best.license", "best.cosine"), "row", "left").join(nearest, F.col("dir") == F.col("of"), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited")
    return out.select("path", F.coalesce("license", "near.license").alias("license"), "cosine", origin.alias("origin"), F.when(F.col("license").isNull(), F.col("near.dir")).alias("origin_dir"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree of one to five levels: source, language, and two levels by id, the upper ones for some ids only."""
    folder = """CASE WHEN doc_id % 13 = 0 THEN coalesce(source, '') WHEN doc_id % 11 = 0 THEN concat_ws('/', coalesce(source, ''), coalesce(lang, ''))
        WHEN doc_id % 3 = 0 THEN concat_ws('/', coalesce(source, ''), coalesce(lang, ''), doc_id % 5)
        ELSE concat_ws('/', coalesce(source, ''), coalesce(lang, ''), coalesce(doc_id % 5, ''), coalesce(doc_id % 35 div 5, '')) END"""
    return scan(table(spark, sf_dir, "documents").select(F.expr(f"concat_ws('/', {folder}, coalesce(string(doc_id), ''))").alias("path"), "text"))


_VALUES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
_TERMS = "[x FOR x IN regexp_split_to_array(lower({0}), '[^a-z0-9]+') IF x <> '']"
OP2_SQL = rf"""
WITH tpl(template, license, text) AS (VALUES {_VALUES}),
ttf AS (
  SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({_TERMS.format("text")}) AS term FROM tpl) GROUP BY ALL
), idf AS (SELECT term, ln({1.0 + len(TEMPLATES)}::DOUBLE / (1.0 + count(*))) + 1.0 AS idf FROM ttf GROUP BY term),
w AS (SELECT template, license, term, tf * idf AS w, idf FROM ttf JOIN idf USING (term)),
known AS (SELECT template, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS weight, idf FROM w),
f AS (
  SELECT row_number() OVER () AS r, CASE WHEN doc_id % 13 = 0 THEN coalesce(source, '') WHEN doc_id % 11 = 0 THEN concat_ws('/', coalesce(source, ''), coalesce(lang, ''))
    WHEN doc_id % 3 = 0 THEN concat_ws('/', coalesce(source, ''), coalesce(lang, ''), (doc_id % 5)::VARCHAR)
    ELSE concat_ws('/', coalesce(source, ''), coalesce(lang, ''), coalesce((doc_id % 5)::VARCHAR, ''), coalesce((doc_id % 35 // 5)::VARCHAR, '')) END AS dir,
    coalesce(doc_id::VARCHAR, '') AS name, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT r, dir, text, len({_TERMS.format("text")}) AS n_terms, string_split(text, chr(10)) AS lines FROM f WHERE regexp_matches(text, '{TRIGGER}')
), ln AS (
  SELECT r, lines, unnest(range(1, len(lines) + 1)) AS k FROM s
), p AS (
  SELECT r, unnest(regexp_split_to_array(text, '{BETWEEN.replace("(", "(?:")}')) AS passage FROM s
  UNION SELECT r, lines[k] FROM ln
  UNION SELECT r, array_to_string(lines[greatest(k - 1, 1):greatest(k - 1, 1) + 2], ' ') FROM ln WHERE regexp_matches(lines[k], '{TRIGGER}')
  UNION SELECT r, array_to_string(lines[k:k + 2], ' ') FROM ln WHERE regexp_matches(lines[k], '{TRIGGER}')
  UNION SELECT r, text FROM s
), h AS (
  SELECT r, passage FROM p WHERE regexp_matches(passage, '{TRIGGER}') AND NOT regexp_matches(passage, '{DENIED}')
), tf AS (
  SELECT r, passage, term, count(*) AS tf FROM (SELECT r, passage, unnest({_TERMS.format("passage")}) AS term FROM h) GROUP BY ALL
), norm AS (
  SELECT r, passage, sqrt(sum((tf * coalesce(idf, ln({1.0 + len(TEMPLATES)}::DOUBLE) + 1.0)) ** 2)) AS norm, sum(tf) AS n FROM tf LEFT JOIN idf USING (term) GROUP BY ALL
), dot AS (
  SELECT r, passage, template, license, sum(tf * idf * weight) AS dot FROM tf JOIN known USING (term) GROUP BY ALL
), m AS (
  SELECT r, n, template, license, round(dot / norm, 6) AS cosine, round(dot, 6) AS evidence FROM dot JOIN norm USING (r, passage) WHERE round(dot / norm, 6) >= {LEAST}
), own AS (
  SELECT r, license, cosine, evidence, template, max(n) OVER (PARTITION BY r) AS n FROM m QUALIFY row_number() OVER (PARTITION BY r ORDER BY license <> 'proprietary' DESC, evidence DESC, cosine DESC, template) = 1
), dirs AS (
  SELECT dir, license FROM s JOIN own USING (r) WHERE n >= {COVERAGE} * n_terms
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY license <> 'proprietary' DESC, evidence DESC, cosine DESC, template) = 1
), walk AS (
  SELECT dir AS below, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM (SELECT DISTINCT dir FROM f)
), near AS (
  SELECT below, d.dir, license FROM walk JOIN dirs d ON d.dir = array_to_string(string_split(below, '/')[1:depth], '/') QUALIFY row_number() OVER (PARTITION BY below ORDER BY depth DESC) = 1
)
SELECT f.dir || '/' || f.name AS path, coalesce(own.license, near.license) AS license, own.cosine,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN own.license IS NULL THEN near.dir END AS origin_dir
FROM f LEFT JOIN own USING (r) LEFT JOIN near ON below = f.dir
"""
