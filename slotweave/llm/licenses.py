"""License scan: Dice coefficient of word bigrams between text and license templates, with DataFrame functions only.

A document's candidate passages are its lines, the sentences in its lines, the
document itself, and paragraphs and sentences that are wrapped over lines.  Passages and templates are normalised (lower case, runs of
anything but letters and digits become one space) and become sets of word
bigrams.  A Dice coefficient of ``t`` needs set sizes within a factor
``(2 - t) / t``; passages outside the bounds of all templates are dropped before
their bigrams are looked up, pairs outside their own bounds right after.

Such a passage also shares a known part of a template's bigrams, so only
documents that hold as many of the templates' bigrams are cut into passages, in
the scan that reads them.  That is exact; no text is read twice or shuffled.

The templates are a parameter; their bigrams are broadcast while there are fewer
than ``BROADCAST_BIGRAMS`` of them (they are counted first).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.llm.text import LETTERS, broadcast_below, checkpoint

THRESHOLD = 0.8
BROADCAST_BIGRAMS = 1_000_000
MOST_LITERALS = 1 << 16
PART, JOIN = "\x1e", "\x1f"

#: Short notices by which texts name their license (fixed values, public wording).
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Paragraphs of license bodies and headers (public wording); the BSD ones that both forms share go by BSD-2-Clause.
BODIES: list[tuple[str, str]] = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", _MIT_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", _BSD_START),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", _BSD_END),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
]


def default_templates(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the notices and the paragraphs of license bodies above."""
    return spark.createDataFrame(NOTICES + BODIES, "license_id string, text string")


def _words(passage: Column) -> Column:
    return F.array_remove(F.split(F.lower(passage), f"[^{LETTERS}]+"), "")


def _pairs(words: str) -> Column:
    """Bigrams in order, hashed."""
    pairs = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1)))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def _bigrams(words: str) -> Column:
    """Distinct bigrams, hashed."""
    return F.array_distinct(_pairs(words))


def passages_of(text: Column) -> Column:
    """Distinct lines, sentences of lines, and the whole of a text; paragraphs and sentences that go over lines, joined: (text, joined)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")
    sentences = F.split(F.regexp_replace(whole, r"([.!?])[ \t]+", "$1\n"), "\n")
    # a line without letters or digits ends a paragraph; JOIN stands for the other line ends and the marks of comments behind them
    parts = F.split(F.regexp_replace(whole, rf"\n(?:[^{LETTERS}\n]*\n)+", PART), PART)
    parts = F.transform(parts, lambda p: F.regexp_replace(p, r"[ \t\r]*\n[ \t]*(?:[#*;%>]+|//+|--+)?[ \t]*", JOIN))
    inner = F.flatten(F.transform(parts, lambda p: F.split(F.regexp_replace(p, rf"([.!?])[ \t{JOIN}]+", f"$1{PART}"), PART)))
    wrapped = F.transform(F.filter(F.transform(F.concat(parts, inner), lambda p: F.btrim(p, F.lit(JOIN + " \t"))), lambda p: F.contains(p, F.lit(JOIN))), lambda p: F.replace(p, F.lit(JOIN), F.lit(" ")))
    mark = lambda passages, joined: F.transform(passages, lambda p: F.struct(p.alias("text"), F.lit(joined).alias("joined")))
    return F.array_distinct(F.concat(mark(F.concat(lines, sentences, F.array(whole)), False), mark(wrapped, True)))


def candidates(docs: DataFrame, grams: DataFrame, least: int) -> DataFrame:
    """(doc_id, text): the documents that hold ``least`` distinct bigrams of the templates, found in one scan.

    The bigrams' hashes are literals of the filter, ``MOST_LITERALS`` at most; of more
    bigrams, classes of hashes are, which lets more documents through and loses none.
    """
    wide = grams.select("bigram").distinct().count() > MOST_LITERALS
    reduced = lambda b: F.pmod(b, F.lit(MOST_LITERALS)) if wide else b
    known = [r["b"] for r in grams.select(reduced(F.col("bigram")).alias("b")).distinct().collect()]
    # the outer explode keeps the filter from being pushed into the computation of the words
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.explode_outer(F.array(_words(F.coalesce("text", F.lit(""))))).alias("w"))
    met = F.filter(_pairs("w"), lambda b: reduced(b).isin(known))
    return worded.withColumn("met", F.explode_outer(F.array(met))).filter(F.size(F.array_distinct("met")) >= least).select("doc_id", "text")


def scan(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """License notices in documents: doc_id, license_id, dice, n_passages.

    One row for each document and license: of a passage's templates at or above
    the threshold the best counts (ties: the smaller license_id); ``dice`` is
    the document's highest and ``n_passages`` its number of distinct passages
    for that license.  Documents without a notice, null and empty texts give no
    row.  Rows with a null doc_id are reported under a null doc_id; rows that
    repeat a doc_id count as one document.  Templates of fewer than two words
    never match, and an empty template table matches nothing.  Other columns are
    ignored.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    worded = templates.select("license_id", F.monotonically_increasing_id().alias("template"), _words(F.col("text")).alias("w"))
    grams = checkpoint(worded.withColumn("b", _bigrams("w")).select("license_id", "template", F.size("b").alias("size"), F.explode_outer("b").alias("bigram")).filter("size > 0"))
    bounds = grams.agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("n")).first()
    if bounds["n"] == 0:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("license_id"), F.lit(0.0).alias("dice"), F.lit(0).cast("long").alias("n_passages")).limit(0)
    factor = (2 - threshold) / threshold
    low, high = bounds["least"] / factor, bounds["most"] * factor
    # a passage shares size / factor bigrams at least with a template that it matches
    found = candidates(docs, grams, max(1, math.ceil(bounds["least"] / factor - 1e-9)))
    # a passage of n characters has fewer than n / 2 words; one of n words at most n - 1 bigrams
    passages = found.select("doc_id", F.explode_outer(passages_of(F.col("text"))).alias("passage"))
    worded_passages = passages.filter(F.length("passage.text") > 2 * low).select("doc_id", "passage", _words(F.col("passage.text")).alias("w"))
    key = F.struct(F.col("passage.joined").alias("joined"), F.xxhash64("w").alias("words"), F.xxhash64(F.when(~F.col("passage.joined"), F.col("passage.text"))).alias("text"))
    worded_passages = worded_passages.select("doc_id", key.alias("passage"), "w")
    # the outer explodes keep filters on computed arrays from being pushed into their computation
    sized = (
        worded_passages.select("doc_id", "passage", F.explode_outer(F.array(_bigrams("w"))).alias("b"))
        .select("doc_id", "passage", "b", F.size("b").alias("n")).filter(F.col("n").between(low, high))
        .select("doc_id", "passage", "n", F.explode_outer("b").alias("bigram"))
    )
    shared = (
        sized.join(broadcast_below(grams, BROADCAST_BIGRAMS), "bigram")
        .filter((F.col("n") <= factor * F.col("size")) & (F.col("size") <= factor * F.col("n")))
        .groupBy("doc_id", "passage", "n", "license_id", "template", "size").agg(F.countDistinct("bigram").alias("both"))
        .withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("size"))).filter(F.col("dice") >= threshold)
    )
    best = shared.groupBy("doc_id", "passage").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "license_id")).alias("best"))
    # joined passages of the words of another one are no further passages
    of_words = best.groupBy("doc_id", "passage.words").agg(F.max(~F.col("passage.joined")).alias("plain"), F.count_if(~F.col("passage.joined")).alias("n_plain"), F.min("best").alias("best"))
    return (
        of_words.groupBy("doc_id", F.col("best.license_id").alias("license_id"))
        .agg(F.max(-F.col("best.minus")).alias("dice"), F.sum(F.when(F.col("plain"), F.col("n_plain")).otherwise(1)).alias("n_passages"))
    )


def oracle_sql(threshold: float = THRESHOLD) -> str:
    values = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in pair) + f", {k})" for k, pair in enumerate(NOTICES + BODIES))
    bigrams = "CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) ELSE [] END"
    words = "list_filter(regexp_split_to_array(lower({}), '[^" + LETTERS.replace("{", "{{").replace("}", "}}") + "]+'), lambda x: x <> '')"
    return rf"""
WITH t AS (SELECT license_id, template, {words.format('txt')} AS w FROM (VALUES {values}) v(license_id, txt, template)),
tb AS (SELECT license_id, template, len(b) AS size, unnest(b) AS bigram FROM (SELECT license_id, template, {bigrams} AS b FROM t)),
x AS (
  SELECT doc_id, x, list_transform(string_split(regexp_replace(x, '\n(?:[^{LETTERS}\n]*\n)+', chr(30), 'g'), chr(30)),
         lambda p: regexp_replace(p, '[ \t\r]*\n[ \t]*(?:[#*;%>]+|//+|--+)?[ \t]*', chr(31), 'g')) AS parts
  FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS x FROM documents)
),
p AS (
  SELECT doc_id, false AS joined, unnest(list_distinct(list_concat(list_concat(string_split(x, chr(10)),
         string_split(regexp_replace(x, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))), [x]))) AS passage
  FROM x
  UNION
  SELECT doc_id, true, unnest(list_transform(list_filter(list_transform(
         list_concat(parts, flatten(list_transform(parts, lambda p: string_split(regexp_replace(p, '([.!?])[ \t\x1f]+', '\1' || chr(30), 'g'), chr(30))))),
         lambda p: trim(p, chr(31) || ' ' || chr(9))), lambda p: contains(p, chr(31))), lambda p: replace(p, chr(31), ' ')))
  FROM x
),
pw AS (SELECT DISTINCT doc_id, joined, CASE WHEN NOT joined THEN passage END AS passage, {words.format('passage')} AS w FROM p),
pb AS (
  SELECT doc_id, joined, passage, array_to_string(w, ' ') AS words, len(b) AS n, unnest(b) AS bigram FROM (SELECT *, {bigrams} AS b FROM pw)
),
d AS (
  SELECT doc_id, joined, passage, words, license_id, template, 2.0::DOUBLE * count(DISTINCT bigram) / (n + size) AS dice
  FROM pb JOIN tb USING (bigram) GROUP BY doc_id, joined, passage, words, n, license_id, template, size
),
best AS (
  SELECT doc_id, joined, passage, words, max(dice) AS dice, arg_min(license_id, (-dice, license_id)) AS license_id
  FROM d WHERE dice >= {threshold} GROUP BY doc_id, joined, passage, words
),
of_words AS (SELECT doc_id, max(dice) AS dice, min(license_id) AS license_id, greatest(1, count(*) FILTER (NOT joined)) AS n FROM best GROUP BY doc_id, words)
SELECT doc_id, license_id, max(dice) AS dice, CAST(sum(n) AS BIGINT) AS n_passages FROM of_words GROUP BY doc_id, license_id
"""
