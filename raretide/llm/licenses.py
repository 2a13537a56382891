"""License scan: normalised text against licence templates by Dice coefficient over word bigrams.

The units of a text that are compared are its lines, the text as a whole, and windows of as many words as the template
has, one from each place where one of the template's bigrams occurs. So a notice is found in the middle of a long line
and where it is wrapped over several lines. A template is only compared with units whose number of bigrams allows the
wanted coefficient, with windows only where the whole text shares enough bigrams and the window holds enough of them.
Before that, texts that hold none of the templates' anchor words are left out: whatever reaches the coefficient shares
so many bigrams with its template that it must hold one of them. All comparisons are made inside a row.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIMILARITY = 0.8

# Licence notices, by licence and wording.
TEMPLATES = {
    ("Apache-2.0", "line"): "Licensed under the Apache License, Version 2.0.",
    ("Apache-2.0", "notice"): (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "line"): "Released under the MIT License.",
    ("MIT", "text"): (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "line"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-3.0", "notice"): (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    ("CC-BY-NC-4.0", "line"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-4.0", "line"): "Licensed under CC BY 4.0.",
    ("CC-BY-SA-4.0", "notice"): (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice"): (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "line"): "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ("ISC", "text"): (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("AGPL-3.0", "notice"): (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."),
    ("LGPL-2.1", "notice"): (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version."),
    ("BSD-3-Clause", "text"): (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE "
        "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("MPL-2.0", "notice"): (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


def normalised_words(text: Column) -> Column:
    """Lower-case words; a word is a run of ASCII letters and digits or of other characters beyond ASCII."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9\\x{80}-\\x{10FFFF}]+"), F.lit(0))


def word_pairs(words: Column) -> Column:
    """Neighbouring pairs of words in their order; none for fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(words: Column) -> Column:
    """Distinct neighbouring pairs of words."""
    return F.array_distinct(word_pairs(words))


def prepared(spark: SparkSession, templates: dict[tuple[str, str], str]) -> list[dict]:
    """license, wording, number of words and distinct bigrams of each given template (with two words or more)."""
    rows = spark.createDataFrame([(a, b, t) for (a, b), t in templates.items()], "license string, wording string, text string")
    words = rows.select("license", "wording", normalised_words(F.col("text")).alias("w"))
    found = words.select("license", "wording", F.size("w").alias("words"), bigrams(F.col("w")).alias("b")).collect()
    return [row.asDict() for row in found if row["b"]]


def shared_bigrams(size: int, similarity: float) -> int:
    """Bigrams that a unit must share with a template of ``size`` bigrams, whatever else it holds."""
    return ceil(size * similarity / (2 - similarity) - 1e-9)


def anchor_words(fixed: list[dict], similarity: float) -> list[str]:
    """Words of which every matching unit holds one.

    A unit shares ``shared_bigrams`` of the template's s bigrams. So of any s minus that many plus one of them, one is
    shared; those with the longest words are taken, as long words are rare, and each stands for its longer word. Their
    number depends on the given templates alone.
    """
    anchors: set[str] = set()
    for t in fixed:
        spare = len(t["b"]) - shared_bigrams(len(t["b"]), similarity) + 1
        longer = (max(pair.split(" "), key=lambda w: (len(w), w)) for pair in t["b"])
        anchors.update(sorted(longer, key=lambda w: (-len(w), w))[:spare])
    return sorted(anchors)


def license_matches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY,
                    templates: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """One row per document and licence found: id, license, wording, dice, line.

    ``dice`` is the best coefficient of any unit of the document with any wording of the licence, at least
    ``similarity``; ``line`` is the number of that line from 0 on, for a window that of the line where it starts, -1
    for the whole text. Ties go to the first wording by name, then to the smallest line. Wordings that resemble each
    other may both reach the coefficient; each licence then has a row. Documents without a match, null and empty texts
    give no row, nor does an empty table. Ids are taken as they are; rows that repeat an id (or have none) give the best
    of their units together, and other columns are not read.
    """
    fixed = prepared(docs.sparkSession, templates or TEMPLATES)
    schema = "array<struct<license string, wording string, words int, size int, least int, b array<string>>>"
    # As large as the given templates: a constant of the plan.
    known = F.from_json(F.lit(json.dumps([{**t, "size": len(t["b"]), "least": shared_bigrams(len(t["b"]), similarity)} for t in fixed])), schema)
    anchors = F.array(*[F.lit(w) for w in anchor_words(fixed, similarity)])
    least, most = similarity / (2 - similarity), (2 - similarity) / similarity

    def dice(b: Column, t: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + t["size"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("t"), normalised_words(F.col(text_column)).alias("words"))
    rows = rows.where(F.arrays_overlap("words", anchors))
    lines = rows.select("id", F.posexplode(F.split("t", "\n")).alias("line", "unit")).withColumn("words", normalised_words(F.col("unit")))
    several = rows.where(F.col("t").contains("\n")).select("id", F.lit(-1).alias("line"), "words")
    units = lines.select("id", "line", "words").union(several).where(F.arrays_overlap("words", anchors))
    sets = units.select("id", "line", bigrams(F.col("words")).alias("b"))
    fitting = F.filter(known, lambda t: F.size("b").between(t["size"] * least, t["size"] * most))
    of_units = sets.select("id", F.inline(F.transform(fitting, lambda t: F.struct(
        t["license"].alias("license"), t["wording"].alias("wording"), F.col("line"), dice(F.col("b"), t).alias("dice")))))

    # Windows: only of the few pairs of a text and a template that share enough bigrams at all.
    held = rows.select("id", "t", word_pairs(F.col("words")).alias("pairs"))
    near = F.filter(known, lambda t: F.size(F.array_intersect("pairs", t["b"])) >= t["least"])
    pairs = held.select("id", "t", "pairs", F.explode(near).alias("template"))
    t, at = F.col("template"), F.sequence(F.lit(1), F.size("pairs"))
    places = pairs.withColumn("at", F.filter(at, lambda p: F.array_contains(t["b"], F.element_at("pairs", p))))
    # a window from the i-th place is worth a look if ``least`` places from there on lie in it
    last = F.col("at")
    starts = F.filter("at", lambda p, i: F.get(last, i + t["least"] - 1) <= p + t["words"] - 2)
    line_of = F.flatten(F.transform(F.split("t", "\n"), lambda x, i: F.array_repeat(i, F.size(normalised_words(x)))))
    seen = places.select("id", "template", "pairs", line_of.alias("line_of"), F.explode(starts).alias("p"))
    window = F.array_distinct(F.slice("pairs", F.col("p"), t["words"] - 1))
    of_windows = seen.select("id", t["license"].alias("license"), t["wording"].alias("wording"),
                             F.element_at("line_of", F.col("p")).alias("line"), dice(window, t).alias("dice"))
    scored = of_units.union(of_windows).where(F.col("dice") >= similarity)
    best = scored.groupBy("id", "license").agg(F.min(F.struct((-F.col("dice")).alias("d"), "wording", "line")).alias("m"))
    return best.select(F.col("id").alias(id_column), "license", F.col("m.wording").alias("wording"), (-F.col("m.d")).alias("dice"),
                       F.col("m.line").alias("line"))
