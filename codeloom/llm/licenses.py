"""License scans by diagonal voting.

Every rolling word k-gram of a text is joined, by hash, to the positions at which the templates have it. A
match at word p of the text and word t of the template lies on diagonal p - t; matches of a copied passage
gather on one diagonal, and on neighbouring ones where words were put in or left out. Matches are summed per
diagonal, neighbouring diagonals of long templates are merged, and a span is verified by the share of the
template's words that exactly matched k-grams cover (the hash only finds candidates: the words themselves
are compared at the join).

Two kinds of templates: phrases (2-grams; every word must match, one diagonal is one place) and longer texts, the
built-in notices and whole licenses and those of a table of the caller's (5-grams; ``least`` of the words must be
covered, diagonals up to ``slack`` apart are merged). The built-in templates have a fixed number of positions and are
broadcast, and so is a table up to ``broadcast_rows``; a larger one is joined by a shuffle of the k-grams.

Words: A-Z lower-cased, then runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].

Defined results
* null or empty text: no words, no places, empty labels, score 0.
* null doc_id: scanned like any other row; rows that repeat a doc_id are told apart by their text.
* repeated rows: the same result for each. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_GRAM, NOTICE_GRAM = 2, 5

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public notices, in the words of their licenses.
NOTICES = {
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "apache-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."
    ),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "isc-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


# Whole texts of public licenses.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_HOLDERS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = {
    "mit-text": NOTICES["mit-notice"] + " " + _AS_IS,
    "bsd-2-text": NOTICES["bsd-notice"] + " " + _HOLDERS,
    "bsd-3-text": (
        NOTICES["bsd-notice"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. " + _HOLDERS
    ),
    "isc-text": (
        NOTICES["isc-notice"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
        "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at "
        "large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE."
    ),
}


@dataclass(frozen=True)
class LicenseParams:
    """least: share of a notice's or given template's words that a span must cover; least_whole: the same for the built-in
    whole texts, which hold notices; slack: distance of diagonals that are merged;
    broadcast_rows: template positions up to which they are sent to every task."""

    least: float = 0.5
    least_whole: float = 0.8
    slack: int = 3
    broadcast_rows: int = 200_000


#: label and text of the templates that are there from the start.
BUILT_IN = [*NOTICES.items(), *TEXTS.items()]


def template_positions(spark: SparkSession, templates: DataFrame | None = None) -> DataFrame:
    """gram (words joined by spaces), k, template, label, phrase, length, t: one row per position.

    templates: label and text of further templates; null and repeated ones, and texts of fewer than NOTICE_GRAM words, have none.
    """
    phrases = spark.createDataFrame([(k, v, True) for k, v in PHRASES.items()], "text string, label string, phrase boolean")
    given = spark.createDataFrame([(t, label, False) for label, t in BUILT_IN], phrases.schema)
    if templates is not None:
        given = given.unionByName(templates.where("label IS NOT NULL AND text IS NOT NULL").select("text", "label", F.lit(False).alias("phrase")))
    rows = phrases.unionByName(given.distinct()).withColumn("w", text_words(F.col("text")))
    rows = rows.withColumn("k", F.when(F.col("phrase"), PHRASE_GRAM).otherwise(NOTICE_GRAM)).where(F.size("w") >= F.col("k"))
    places = F.sequence(F.lit(0), F.size("w") - F.col("k"))
    found = rows.select(
        "k", F.concat_ws(":", "label", F.xxhash64("text")).alias("template"), "label", "phrase", F.size("w").alias("length"), "w",
        F.explode(places).alias("t"),
    )
    gram = F.slice("w", F.col("t") + 1, F.col("k"))
    return found.select(F.array_join(gram, " ").alias("gram"), "k", "template", "label", "phrase", "length", "t", _gram_hash(F.col("k"), gram, None).alias("h"))


def _gram_hash(k: Column, words: Column, size: int | None) -> Column:
    """Hash of the k-gram at the head of words. size fixes k for a plan without branches."""
    if size is not None:
        return F.xxhash64(F.lit(size), *[F.get(words, F.lit(i)) for i in range(size)])
    return F.when(k == PHRASE_GRAM, _gram_hash(k, words, PHRASE_GRAM)).otherwise(_gram_hash(k, words, NOTICE_GRAM))


def text_words(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def matches(docs: DataFrame, params: LicenseParams = LicenseParams(), templates: DataFrame | None = None) -> DataFrame:
    """doc_id, tk, p (word position) and the template position of every k-gram that a template has."""
    positions = template_positions(docs.sparkSession, templates)
    if templates is not None:  # of unknown size: looked at once, and joined by a shuffle when large
        positions = common.written(positions, "license-positions")
    small = templates is None or positions.count() <= params.broadcast_rows
    words = docs.select("doc_id", common.text_key(F.col("text")).alias("tk"), text_words(F.col("text")).alias("w"))
    shifted = [F.slice("w", F.lit(i + 1), F.greatest(F.size("w") - i, F.lit(0))).alias(f"w{i}") for i in range(NOTICE_GRAM)]
    rows = words.select("doc_id", "tk", F.posexplode(F.arrays_zip(*shifted)).alias("p", "x"))
    own = [F.col(f"x.w{i}") for i in range(NOTICE_GRAM)]
    last = lambda k: own[k - 1].isNotNull()
    hashes = [F.when(last(k), F.xxhash64(F.lit(k), *own[:k])) for k in (PHRASE_GRAM, NOTICE_GRAM)]
    hashed = rows.select(
        "doc_id", "tk", "p", *[c.alias(f"w{i}") for i, c in enumerate(own)], F.explode(F.array(*hashes)).alias("h")
    )
    found = hashed.where("h IS NOT NULL").join(F.broadcast(positions) if small else positions, "h")
    exact = F.when(F.col("k") == PHRASE_GRAM, F.concat_ws(" ", "w0", "w1")).otherwise(
        F.concat_ws(" ", *[f"w{i}" for i in range(NOTICE_GRAM)])
    )
    return found.where(exact == F.col("gram")).select("doc_id", "tk", "p", "template", "label", "phrase", "length", "k", "t")


def spans(docs: DataFrame, params: LicenseParams = LicenseParams(), templates: DataFrame | None = None) -> DataFrame:
    """doc_id, tk, template, label, phrase, first (word), last (word), coverage of every verified span."""
    key = ["doc_id", "tk", "template", "label", "phrase", "length", "k"]
    votes = matches(docs, params, templates).groupBy(*key, (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.collect_set("t").alias("ts"), F.min("p").alias("lo"), F.max("p").alias("hi")
    )
    order = Window.partitionBy("doc_id", "tk", "template").orderBy("diagonal")
    gap = F.when(F.col("phrase"), F.lit(0)).otherwise(F.lit(params.slack))
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    merged = (
        votes.withColumn("fresh", fresh.cast("int"))
        .withColumn("chain", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "chain")
        .agg(F.flatten(F.collect_list("ts")).alias("ts"), F.min("lo").alias("first"), (F.max("hi") + F.max("k") - 1).alias("last"))
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.col("k") - 1))))
    ) / F.col("length")
    judged = merged.withColumn("coverage", covered)
    least = F.when(F.col("phrase"), 1.0).when(F.col("label").isin(*TEXTS), params.least_whole).otherwise(params.least)
    return judged.where(F.col("coverage") >= least).select(
        "doc_id", "tk", "template", "label", "phrase", "first", "last", "coverage"
    )


def scan(docs: DataFrame, params: LicenseParams = LicenseParams(), templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    templates: a table of label and text to scan for besides the built-in ones.
    """
    base = F.col("phrase")
    found = spans(docs, params, templates).groupBy("doc_id", "tk").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    found = found.select(F.col("doc_id").alias("__doc"), F.col("tk").alias("__tk"), *found.columns[2:])
    rows = docs.select(
        "doc_id", common.text_key(F.col("text")).alias("tk"), F.size(text_words(F.col("text"))).cast("long").alias("n_words")
    )
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("tk") == F.col("__tk")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
