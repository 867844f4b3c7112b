"""License scans: text against licence templates by the Dice coefficient of word bigrams, natively.

A text is compared as a whole, by paragraph and by line, since notices stand in
documents. Words are the runs of letters and digits of the lower-cased text. The
coefficient of a unit with a bigrams and a template with b is twice their shared
bigrams over a + b, repeats counted.

Two bounds prune templates, and neither loses a match. Size: with coefficient t,
a lies between b * t / (2 - t) and b * (2 - t) / t. Overlap: then at least
ceil(b * t / (2 - t)) of the template's bigrams are shared, so one of any
b - ceil(b * t / (2 - t)) + 1 of them is; the rarest among the templates are taken
as its anchors. Units are hashed and met with the anchors where they are read;
only units with an anchor of a template that fits their size are compared.
Templates are a fixed list, or a small table that is broadcast up to
``MAX_TEMPLATES`` rows; more are refused.

Defined results. Units of fewer than two words have no bigrams and match nothing;
null text counts as empty. A document has one row for each licence found, with
its best coefficient; rows that share an id, null included, count as one
document. Repeated rows and equal units change nothing. An empty table on either
side gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.llm.decontaminate import words
from recollex.storage import materialize

THRESHOLD = 0.8
MAX_TEMPLATES = 10_000

# Public licence notices and short licence texts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", _BSD2),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
]


def templates_frame(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, template text); a licence may have several."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates or TEMPLATES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _pairs(w: Column) -> Column:
    """The bigrams of an array of at least two words."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))


def _numbered(pairs: str) -> Column:
    """Each bigram of a column with the number of times that it came before, so that repeats differ."""
    return F.transform(pairs, lambda p, i: F.concat_ws("#", p, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q == p)).cast("string")))


def _prepared(templates: DataFrame, threshold: float) -> DataFrame:
    """Templates with their number, bigrams, size bounds and anchors."""
    w = templates.filter("text is not null").select("license", words(F.col("text")).alias("w")).filter(F.size("w") > 1).distinct()
    placed = w.select("license", F.xxhash64("license", "w").alias("number"), F.posexplode(_pairs(F.col("w"))).alias("at", "pair"))
    times = F.row_number().over(Window.partitionBy("number", "pair").orderBy("at")) - 1  # as often as it came before
    one = placed.withColumn("b", F.concat_ws("#", "pair", times.cast("string")))
    share = F.lit(threshold / (2 - threshold))
    often = one.groupBy("pair").agg(F.countDistinct("number").alias("often"))
    # Function words make a pair of use in any prose; pairs of longer words come first.
    ranked = one.join(often, "pair").groupBy("license", "number").agg(F.collect_list("b").alias("bigrams"), F.array_sort(F.collect_set(F.struct("often", (-F.length("pair")).alias("short"), "b", "pair"))).alias("ranked"))
    size = F.size("bigrams")
    least = F.ceil(size * share - 1e-9)
    return ranked.select(
        "license", "number", "bigrams", size.alias("size"), least.alias("smallest"), F.floor(size / share + 1e-9).alias("largest"),
        F.array_distinct(F.transform(F.slice("ranked", F.lit(1), (size - least + 1).cast("int")), lambda r: r["pair"])).alias("anchors"),
    )


def detect(docs: DataFrame, templates: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, license, dice): the licences found in each document."""
    ready = materialize(_prepared(templates, threshold), "licence-templates")
    bounds = ready.agg(F.count(F.lit(1)), F.min("smallest"), F.max("largest")).first()
    if bounds[0] > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    texts = docs.select(F.col(key).alias("doc"), F.coalesce(text, F.lit("")).alias("text"))
    parts = F.array_distinct(F.concat(F.array("text"), F.split("text", r"\n[ \t\r]*\n"), F.split("text", "\n")))
    units = texts.select("doc", F.explode(parts).alias("unit")).select("doc", words(F.col("unit")).alias("w"))
    # No template fits another size.
    units = units.filter((F.size("w") > F.lit(bounds[1] or 0)) & (F.size("w") <= F.lit((bounds[2] or 0) + 1)))
    hashed = units.select("doc", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    pairs = hashed.select("doc", "w", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 2)).alias("at"))
    anchors = ready.select("number", "smallest", "largest", F.explode("anchors").alias("pair")).select(
        "number", "smallest", "largest", F.xxhash64(F.xxhash64(F.substring_index("pair", " ", 1)), F.xxhash64(F.substring_index("pair", " ", -1))).alias("anchor")
    )
    met = pairs.join(
        F.broadcast(anchors),  # at most MAX_TEMPLATES templates
        (F.xxhash64(F.get("h", F.col("at")), F.get("h", F.col("at") + 1)) == F.col("anchor")) & (F.size("w") - 1).between(F.col("smallest"), F.col("largest")),
    ).select("doc", "w", "number").distinct()
    # The pairs are a column of their own: as an expression they would be made anew for each element of the lambda.
    paired = met.withColumn("pairs", _pairs(F.col("w"))).withColumn("own", _numbered("pairs"))
    shared = F.size(F.array_intersect("own", "bigrams"))
    compared = paired.join(F.broadcast(ready), "number").select("doc", "license", (2 * shared / (F.size("w") - 1 + F.col("size"))).alias("dice"))
    return compared.filter(F.col("dice") >= threshold).groupBy(F.col("doc").alias(key), "license").agg(F.max("dice").alias("dice"))
