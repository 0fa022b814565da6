"""Licence scans: TF-IDF cosine of licence headers and licence files to templates, and inheritance from the nearest
ancestor directory, in DataFrame functions only.

A header is a line of a document that mentions a licence or copyright; each is compared as a sparse TF-IDF vector with the
header templates. A document that holds the typical words of a licence's body is compared as a whole with the texts of
licences too. Inverse document frequencies are those among the templates, so a document's similarity depends on nothing
but its text. In a header a term of no template weighs 1. In whole texts a term counts by the logarithm of its number, one
that most licences hold weighs next to nothing, and one that none holds weighs ``UNKNOWN``, so a name of a holder or a
program below the licence changes little and another licence's words much. The best template of at least
``MIN_SIMILARITY``, and among whole texts of at least ``MIN_BODY_SIMILARITY``, is the document's own licence; a whole text
goes before a header. Licences name other licences: in a text of a licence's kind, of which lines that mention licences make
up at least ``LEGAL_SHARE`` of the words, a header counts only where at least ``HEADER_SHARE`` of such lines are headers.
A licence file is a document that is like a licence's text and at most 1/``TEXT_SHARE`` times as long, or whose licensed headers hold at
least ``FILE_SHARE`` of its words; it declares its licence for its directory and all below, until a nearer declaration. A
document without a licence of its own takes the one that the nearest ancestor directory declares.

Headers are compared in each row, so copies gather in no task; whole texts as (text, term) rows that meet the broadcast
terms of the fixed templates. Paths are joined by distinct directory, and directories that hold very many rows are
broadcast. Nothing of the documents reaches the driver.

Cases: a null or empty text has no header. A null path inherits nothing. Ties between templates go to the first in the
list, between licence files of one directory to the more similar, then the lower doc_id. Repeated rows give repeated
results. Extra columns aren't carried. An empty table gives an empty result. A line or text without a letter or digit is
like nothing. Ids of any type that orders.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import join_hot, stage

MIN_SIMILARITY = 0.6
MIN_BODY_SIMILARITY = 0.65
FILE_SHARE = 0.3
TEXT_SHARE = 0.5
UNKNOWN = 0.3
LEGAL_SHARE = 0.1
HEADER_SHARE = 0.125

#: Names of licences and the sentences by which files state them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause style license."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause style license."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "Copyright. All rights reserved. No license is granted."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved."),
]
#: Licences that an SPDX tag may name.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict(TEMPLATES) if name != "Proprietary"]

#: Whole texts of longer licences, a file for each, as Debian's base-files package distributes them.
TEXTS = Path(__file__).with_name("licence_texts")
#: Fixed value: the section by which the Affero licence differs from the general one, as far as its words tell it apart.
_REMOTE = (
    "Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must "
    "prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source "
    "of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software."
)


def whole_texts(folder: Path = TEXTS) -> list[tuple[str, str]]:
    """(licence, text) of each file of a folder, by name, and the Affero licence, made of the general one's text."""
    texts = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]
    return texts + [("AGPL-3.0", re.sub("(?i)GNU General", "GNU Affero General", x) + _REMOTE) for name, x in texts if name == "GPL-3.0"]


#: Short texts of licences as they stand in licence files, and the notices by which files state long ones.
BODIES = whole_texts() + [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
dedication for the benefit of the public at large and to the detriment of our heirs and successors."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
]
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BODIES += [("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END)]
#: The notice of the GNU licences; they differ in name and version.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."
)
BODIES += [(short, _GNU.format(name=name, version=version)) for short, name, version in (("GPL-3.0", "General", 3), ("GPL-2.0", "General", 2), ("LGPL-3.0", "Lesser General", 3), ("AGPL-3.0", "Affero General", 3))]

#: A line that mentions a licence, and a text that may be a licence's.
MENTION = "(?i)licen[cs]|copyright|all rights reserved|public domain|spdx"
BODY = (
    r"(?i)permission\s+(is\s+hereby\s+granted|to\s+use)|redistribution\s+and\s+use|without\s+warrant(y|ies)|unencumbered\s+software|free\s+software|subject\s+to\s+the\s+terms"
    r"|representations\s+or\s+warranties|implied\s+warranties|warranty\s+disclaimers|terms\s+and\s+conditions"
)


def terms_of(line: str) -> list[str]:
    return re.findall("[a-z0-9]+", line.lower())


def terms(line: Column) -> Column:
    """Lower-case runs of ASCII letters and digits of a line."""
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda t: t != "")


def with_path(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / thousands of ids / hundreds of ids / id."""
    number = F.col("doc_id")
    path = F.concat_ws("/", F.col("source"), F.concat(F.lit("d"), F.floor(number / 1000).cast("string")), F.concat(F.lit("e"), F.floor(number / 100).cast("string")), F.concat(number.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.when(F.col("source").isNotNull() & number.isNotNull(), path).alias("path"), "text")


def headers(files: DataFrame) -> DataFrame:
    """doc_id, path, dir, n_words, the terms of each line that mentions a licence, and those of the whole text if it may be
    a licence's."""
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(MENTION))
    mentions = F.col("text").rlike(MENTION)
    none = F.array().cast("array<array<string>>")
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    n_words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    return files.select(
        "doc_id",
        "path",
        directory.alias("dir"),
        F.when(mentions, n_words(F.col("text"))).otherwise(0).alias("n_words"),
        F.when(mentions, F.transform(lines, terms)).otherwise(none).alias("lines"),
        F.when(mentions, F.aggregate(lines, F.lit(0), lambda a, x: a + n_words(x))).otherwise(0).alias("header_words"),
        F.when(F.col("text").rlike(BODY), terms(F.col("text"))).alias("body"),
    )


def inverse_frequencies(templates: list[tuple[str, str]]) -> dict[str, float]:
    """Inverse document frequency of each term among some templates."""
    df = Counter(t for _, text in templates for t in set(terms_of(text)))
    return {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}


def _weighted(text: str, idf: dict[str, float]) -> dict[str, float]:
    """A template's vector, of length 1, times the inverse frequencies: what a text's term counts are multiplied with."""
    own = Counter(terms_of(text))
    norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items()))
    return {t: n * idf[t] * idf[t] / norm for t, n in own.items()}


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def _norm(line: Column, weight: Column) -> Column:
    """The length of a line's vector: one pass over its sorted terms, counting runs."""
    square = lambda s: F.pow(s["n"] * F.coalesce(F.try_element_at(weight, s["term"]), F.lit(1.0)), F.lit(2.0))
    start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    step = lambda s, t: F.when(
        s["term"] == t, F.struct(s["term"].alias("term"), (s["n"] + 1.0).alias("n"), s["sum"].alias("sum"))
    ).otherwise(F.struct(t.alias("term"), F.lit(1.0).alias("n"), (s["sum"] + square(s)).alias("sum")))
    return F.sqrt(F.aggregate(F.array_sort(line), start, step, lambda s: s["sum"] + square(s)))


def best_template(line: Column, templates: list[tuple[str, str]]) -> Column:
    """struct(similarity, rank, licence) of the template nearest to a line's terms; a lower place gives a higher rank."""
    idf = inverse_frequencies(templates)
    norm = _norm(line, _literal_map(idf))
    choices = []
    for k, (name, text) in enumerate(templates):
        parts = _literal_map(_weighted(text, idf))
        dot = F.aggregate(line, F.lit(0.0), lambda a, t: a + F.coalesce(F.try_element_at(parts, t), F.lit(0.0)))  # noqa: B023
        choices.append(F.struct(F.round(dot / norm, 9).alias("similarity"), F.lit(-k).alias("rank"), F.lit(name).alias("licence")))
    return F.when(F.size(line) > 0, F.array_max(F.array(*choices)))


def body_frequencies(bodies: list[tuple[str, str]]) -> dict[str, float]:
    """Inverse document frequency of each term among the texts of licences, next to nothing for a term of all."""
    df = Counter(t for _, text in bodies for t in set(terms_of(text)))
    return {t: math.log((1 + len(bodies)) / (0.5 + n)) for t, n in df.items()}


def _body_parts(text: str, idf: dict[str, float]) -> dict[str, float]:
    """As ``_weighted``, of damped term counts."""
    own = {t: 1 + math.log(n) for t, n in Counter(terms_of(text)).items()}
    norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in own.items()))
    return {t: n * idf[t] * idf[t] / norm for t, n in own.items()}


def best_bodies(found: DataFrame, bodies: list[tuple[str, str]], unknown: float = UNKNOWN) -> DataFrame:
    """file_no and the struct(similarity, rank, licence) of the licence's text nearest to each whole text that may be one."""
    spark, idf = found.sparkSession, body_frequencies(bodies)
    names = F.array(*[F.lit(name) for name, _ in bodies])
    # for each term its own weight and its parts in the texts that hold it: one literal, as large as the fixed templates
    held = {t: {"weight": w, "parts": []} for t, w in sorted(idf.items())}
    for k, (_, text) in enumerate(bodies):
        for t, part in sorted(_body_parts(text, idf).items()):
            held[t]["parts"].append({"k": k, "part": part})
    schema = "map<string, struct<weight: double, parts: array<struct<k: int, part: double>>>>"
    weights = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(held)), schema)).alias("term", "held")).select("term", "held.*")
    counts = found.where(F.size("body") > 0).select("file_no", F.explode("body").alias("term")).groupBy("file_no", "term").agg((1 + F.log(F.count("*"))).alias("n"))
    known = stage(counts.join(F.broadcast(weights), "term", "left"), "licence-terms")
    norms = known.groupBy("file_no").agg(F.sqrt(F.sum(F.pow(F.col("n") * F.coalesce("weight", F.lit(unknown)), F.lit(2.0)))).alias("norm"))
    dots = known.select("file_no", "n", F.inline("parts")).groupBy("file_no", "k").agg(F.sum(F.col("n") * F.col("part")).alias("dot"))
    like = F.struct(F.round(F.col("dot") / F.col("norm"), 9).alias("similarity"), (-F.col("k")).alias("rank"), F.element_at(names, F.col("k") + 1).alias("licence"))
    return dots.join(norms, "file_no").groupBy("file_no").agg(F.max(like).alias("whole"))


def _counted(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Facts with the number of rows that hold their key."""
    return stage(facts.join(rows.groupBy(key).agg(F.count("*").alias("held_by")), key), "licence-facts")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, min_similarity: float = MIN_SIMILARITY, file_share: float = FILE_SHARE, bodies: list[tuple[str, str]] = BODIES, min_body_similarity: float = MIN_BODY_SIMILARITY) -> DataFrame:
    """doc_id, path, licence, similarity, basis (header, file, inherited, none), from_dir and levels_up of every file."""
    found = stage(headers(files.select("doc_id", "path", "text")).withColumn("file_no", F.monotonically_increasing_id()), "licence-headers")
    line = F.filter(F.transform("lines", lambda x: best_template(x, templates)), lambda x: x["similarity"] >= min_similarity)
    long_enough = F.array(*[F.lit(len(terms_of(text)) / TEXT_SHARE) for _, text in bodies])
    whole = F.when(F.col("whole.similarity") >= min_body_similarity, F.col("whole"))
    legal = F.col("body").isNotNull() & (F.col("header_words") >= F.lit(LEGAL_SHARE) * F.col("n_words")) & (F.size("like") < F.lit(HEADER_SHARE) * F.size("lines"))
    own = (
        found.join(stage(best_bodies(found, bodies), "licence-bodies"), "file_no", "left")
        .withColumn("like", line)
        .withColumn("line", F.when(~legal, F.array_max("like")))
        .withColumn("whole", whole)
        .withColumn("is_file", (F.col("whole").isNotNull() & (F.size("body") <= F.element_at(long_enough, 1 - F.col("whole.rank")))) | F.coalesce(F.col("line").isNotNull() & (F.col("header_words") >= F.lit(file_share) * F.col("n_words")), F.lit(False)))
        .select("doc_id", "path", "dir", F.coalesce("whole", "line").alias("best"), "is_file")
    )
    own = stage(own, "licence-own")
    declared = (
        own.where(F.col("is_file") & F.col("dir").isNotNull())
        .groupBy(F.col("dir").alias("at"))
        .agg(F.min(F.struct((-F.col("best.similarity")).alias("unlike"), (-F.col("best.rank")).alias("place"), "doc_id", F.col("best").alias("best"))).alias("first"))
        .select("at", F.col("first.best").alias("declared"))
    )
    ups = own.where(F.col("best").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    above = ups.select("dir", F.explode(F.sequence(F.lit(0), F.size(F.split("dir", "/")))).alias("levels_up")).select(
        "dir", "levels_up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.size(F.split("dir", "/")) - F.col("levels_up")), "/").alias("at")
    )
    above = stage(above, "licence-above")
    nearest = join_hot(above, _counted(above, declared, "at"), ["at"], "held_by").groupBy("dir").agg(F.min(F.struct("levels_up", "at", "declared")).alias("nearest"))
    got = join_hot(own, _counted(own, nearest, "dir"), ["dir"], "held_by", "left")
    inherited = F.col("best").isNull() & F.col("nearest").isNotNull()
    return got.select(
        "doc_id",
        "path",
        F.coalesce("best.licence", "nearest.declared.licence").alias("licence"),
        F.coalesce("best.similarity", "nearest.declared.similarity").alias("similarity"),
        F.when(F.col("is_file"), F.lit("file")).when(F.col("best").isNotNull(), F.lit("header")).when(inherited, F.lit("inherited")).otherwise(F.lit("none")).alias("basis"),
        F.when(inherited, F.col("nearest.at")).alias("from_dir"),
        F.when(inherited, F.col("nearest.levels_up")).alias("levels_up"),
    )
