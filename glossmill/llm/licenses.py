"""Licence scan: sparse TF-IDF cosine to licence templates, then inheritance from the nearest directory above.

A passage is a line that holds a licence word; a paragraph of several lines that does; such a paragraph with up to
five that follow; and of a file named LICENSE, LICENCE, COPYING or NOTICE every paragraph and the whole text. Lines
are compared with TEMPLATES, paragraphs also with HEADERS and TEXTS, longer passages with TEXTS, which go first: a
licence of several paragraphs may begin as another does. A line or paragraph with an SPDX identifier is of the licence
that it names (the first of an expression, without -only, -or-later or +) and isn't compared. Inverse document frequencies count all files; tokens that no template has weigh as if no file had them.
A file's own licence is its best passage's best template, from ``least`` cosine on (ties: the least template). A
file is a licence file if it is named so, or if half of its words are licensing passages; its licence is its
directory's. Files without their own take the licence of their directory or the nearest one above that has one.
Different lines are scored once each, however many files repeat them. Only column expressions are used.

Cases: null text has no licence of its own. Rows with a null path count in the frequencies and have no row in the
result. Rows that repeat a path are one file. Paths without "/" are in the root directory "". No rows: no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.llm.workspace import Workspace

#: Short forms of common licences, as files state them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
_MET = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NEITHER = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Titles of long licences, and full headers.
HEADERS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *((name, f"GNU {kind} Version {version}") for name, kind, version in (
        ("AGPL-3.0", "Affero General Public License", "3, 19 November 2007"), ("GPL-2.0", "General Public License", "2, June 1991"), ("GPL-3.0", "General Public License", "3, 29 June 2007"),
        ("LGPL-2.1", "Lesser General Public License", "2.1, February 1999"), ("LGPL-3.0", "Lesser General Public License", "3, 29 June 2007"),
    )),
    *((name, "This program " + _GNU.format(kind, version)) for name, kind, version in (
        ("AGPL-3.0", "Affero General Public License", "3"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
        ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
    )),
)
#: Full texts of several paragraphs.
TEXTS = (
    ("BSD-2-Clause", _MET + _AS_IS),
    ("BSD-3-Clause", _MET + _NEITHER + _AS_IS),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: A longer passage has a licence of TEXTS from this cosine on.
_LEAST_TEXT = 0.8
#: Kinds of passages, which are compared with these templates.
_LINE, _PARAGRAPH, _LONG = 0, 1, 2
_COMPARED = {_LINE: TEMPLATES, _PARAGRAPH: TEMPLATES + HEADERS + TEXTS, _LONG: TEXTS}
#: Words by which a line is looked at, as they begin in lower case.
WORDS = ("licens", "licenc", "spdx", "permission is hereby granted", "redistribution and use")
_NAMED = r"(?:^|/)(?:LICEN[SC]E|COPYING|NOTICE)(?:\.[^/]*)?$"
_BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
#: An SPDX identifier and what it may end with.
IDENTIFIER, SUFFIX = r"(?i)SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9]+(?:[.+-]+[A-Za-z0-9]+)*[+]?)", r"(?i)(-(only|or-later)|[+])$"
_SPLIT = r"[^\p{L}\p{N}]+"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def _has_word(text: Column) -> Column:
    held = F.lit(False)
    for w in WORDS:
        held = held | F.contains(F.lower(text), F.lit(w))
    return held


def _passages(text: Column, named: Column) -> Column:
    """Structs (kind, passage); text isn't null."""
    of = lambda kind, texts: F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("passage")))
    paragraphs = F.split(text, _BLANK)
    several = F.filter(paragraphs, lambda x: named | (_has_word(x) & F.contains(x, F.lit("\n"))))
    starts = F.filter(F.sequence(F.lit(1), F.size(paragraphs)), lambda i: _has_word(F.get(paragraphs, i - 1)))
    spans = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.lit(6)), lambda k: F.when(i + k <= F.size(paragraphs) + 1, F.array_join(F.slice(paragraphs, i, k), "\n")))))
    long = F.concat(F.filter(spans, lambda x: x.isNotNull()), F.when(named, F.array(text)).otherwise(F.array().cast("array<string>")))
    lines = F.when(named, F.array().cast("array<string>")).otherwise(F.filter(F.split(text, "\n"), _has_word))
    return F.concat(of(_LINE, lines), of(_PARAGRAPH, several), of(_LONG, long))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, least: float = 0.6) -> DataFrame:
    """From (path, text) to (path, license, how, score), once per path: how is own, inherited or null."""
    spark = files.sparkSession
    work = Workspace(spark, "licenses")
    files = files.select(F.col("path").cast("string"), F.col("text").cast("string"))
    compared = [(kind, n, name, text) for kind, some in _COMPARED.items() for n, (name, text) in enumerate(some)]
    templates = spark.createDataFrame(compared, "kind int, template int, name string, text string")
    terms = templates.select("kind", "template", F.explode(_tokens(F.col("text"))).alias("token")).groupBy("kind", "template", "token").agg(F.count("*").alias("tf"))
    used = [(r["kind"], r["token"]) for r in terms.select("kind", "token").distinct().collect()]
    vocabulary = sorted({t for _, t in used})  # of the templates

    # Frequencies over all files; a table of the vocabulary's size comes back.
    among = F.array(*[F.lit(t) for t in vocabulary])
    found = files.where("text is not null").select(F.explode(F.array_union(F.array_intersect(_tokens(F.col("text")), among), F.array(F.lit("")))).alias("token"))
    df = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    total = df.get("", 0)
    idf = spark.createDataFrame([(kind, t, df.get(t, 0)) for kind, t in used], "kind int, token string, df long")
    weigh = lambda n: F.log((1.0 + total) / (1.0 + n)) + 1.0
    idf = F.broadcast(idf.select("kind", "token", weigh(F.col("df")).alias("idf")))
    parts = terms.join(idf, ["kind", "token"]).select("kind", "template", "token", (F.col("tf") * F.col("idf")).alias("w"))
    norms = parts.groupBy("kind", "template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_norm"))
    model = parts.join(norms, ["kind", "template"]).join(templates.select("kind", "template", "name"), ["kind", "template"])
    model = F.broadcast(model.select("kind", "template", "name", "token", (F.col("w") / F.col("template_norm")).alias("u")))

    named = F.coalesce(F.col("path").rlike(_NAMED), F.lit(False))
    held = files.where(_has_word(F.col("text")) | named).select("path", F.size(_tokens(F.col("text"))).alias("words"), named.alias("named"), F.inline(F.when(F.col("text").isNotNull(), _passages(F.col("text"), named))))
    held = work.cut(held.where("passage is not null"), "passages")
    named_as = F.regexp_replace(F.regexp_extract("passage", IDENTIFIER, 1), SUFFIX, "")
    distinct = held.select("kind", "passage").distinct().select("kind", "passage", F.sha2("passage", 256).alias("key"), F.when(F.col("kind") != _LONG, named_as).otherwise("").alias("identifier"))
    exact = distinct.where("identifier <> ''").select("kind", "key", F.lit(1.0).alias("score"), F.col("identifier").alias("license"))
    different = distinct.where("identifier = ''")
    counts = different.select("kind", "key", F.explode(_tokens(F.col("passage"))).alias("token")).groupBy("kind", "key", "token").agg(F.count("*").alias("tf"))
    weighed = counts.join(idf, ["kind", "token"], "left").select("kind", "key", "token", (F.col("tf") * F.coalesce("idf", weigh(F.lit(0)))).alias("w"))
    weighed = work.cut(weighed, "weighed")
    length = weighed.groupBy("kind", "key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    cosine = weighed.join(model, ["kind", "token"]).groupBy("kind", "key", "template", "name").agg(F.sum(F.col("w") * F.col("u")).alias("dot")).join(length, ["kind", "key"])
    cosine = cosine.select("kind", "key", "template", "name", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= F.when(F.col("kind") == _LONG, _LEAST_TEXT).otherwise(least))
    best = cosine.groupBy("kind", "key").agg(F.max(F.struct("score", (-F.col("template")).alias("order"), "name")).alias("b")).select("kind", "key", "b.score", F.col("b.name").alias("license"))

    best = best.unionByName(exact)
    own = held.withColumn("key", F.sha2("passage", 256)).join(best, ["kind", "key"])
    own = own.select("kind", "path", "words", "named", "license", "score", F.size(_tokens(F.col("passage"))).alias("covered"))
    own = own.where("path is not null").groupBy("path").agg(
        F.max(F.struct((F.col("kind") == _LONG).alias("long"), "score", "license")).alias("b"), F.max("named").alias("named"),
        # Paragraphs hold lines that may be licensing passages already.
        F.coalesce(F.sum(F.when(F.col("kind") == _LINE, F.col("covered"))), F.max("covered")).alias("covered"), F.max("words").alias("words")
    )
    own = work.cut(own.select("path", "b.license", "b.score", (F.col("named") | (F.col("covered") * 2 >= F.col("words"))).alias("declares")), "own")

    # Each different directory asks every one above it; the nearest that declares a licence answers.
    declared = own.where("declares").withColumn("at", _directory(F.col("path"))).groupBy("at").agg(F.max(F.struct("score", "license")).alias("b"))
    declared = declared.select("at", F.col("b.license").alias("declared"))
    paths = files.where("path is not null").select("path", _directory(F.col("path")).alias("directory")).distinct()
    levels = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(levels)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(levels, F.lit(1), n), "/")))
    asking = paths.select("directory").distinct().select("directory", F.posexplode(above).alias("depth", "at"))
    answers = asking.join(declared, "at").groupBy("directory").agg(F.max(F.struct("depth", "declared")).alias("a")).select("directory", F.col("a.declared").alias("declared"))
    answers = work.cut(answers, "answers")  # so Spark knows whether they are few enough to broadcast
    out = paths.join(own.drop("declares"), "path", "left").join(answers, "directory", "left")
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("declared").isNotNull(), "inherited")
    return out.select("path", F.coalesce("license", "declared").alias("license"), how.alias("how"), "score")
