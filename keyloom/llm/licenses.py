"""License scans by diagonal voting.

All runs of K words of a text are hashed. Those that occur in a template are joined to the template's
positions; each match votes for a diagonal (position in the text minus position in the template).
Votes are summed by text, template and diagonal, neighbouring diagonals are merged, and each merged
span is verified by its edit similarity to the template. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

K, GAP, LEAST_VOTES, LEAST_SIMILARITY = 4, 3, 2, 0.8
#: Label and phrase.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Label and text of public license notices. A bounded table; it is part of the program.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of lower-cased text. lower() also folds letters beyond A-Z: that joins and cuts no word and makes no a-z that a phrase has."""
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def grams(words: Column) -> Column:
    """Hashes of all runs of K words; none for shorter texts."""
    hashed = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    run = F.transform(hashed, lambda a: F.transform(F.slice(a, F.lit(1), F.size(a) - (K - 1)), lambda x, i: F.xxhash64(x, *[a[i + k] for k in range(1, K)])))
    return F.when(F.size(words) >= K, run[0]).otherwise(F.array().cast("array<bigint>"))


def template_table(spark) -> DataFrame:
    """template, label, ttext, size (in words), hash, tpos: a row per run of K words of each template."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(TEMPLATES)], "template int, label string, text string")
    rows = rows.withColumn("w", words_of(F.col("text")))
    rows = rows.select("template", "label", F.array_join("w", " ").alias("ttext"), F.size("w").alias("size"), F.posexplode(grams(F.col("w"))).alias("tpos", "hash"))
    return rows


def _starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    return F.array(words), lambda a: F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: _all([F.coalesce(F.get(a, i + k) == p, F.lit(False)) for k, p in enumerate(parts)]))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of docs.

    score: the best similarity of a verified span; 0.5 for phrases alone; else 0. Null text is empty
    text (no words, null first and last, empty labels). Rows are told apart by a number given when they
    are first read, so repeated rows and null ids keep their own results; an empty table gives none.
    Columns of docs besides doc_id and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    templates = template_table(spark)
    known = [r["hash"] for r in templates.select("hash").distinct().collect()]  # of the program's own templates
    t = docs.select(F.col("doc_id"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    t = t.withColumn("w", words_of(F.col("t")))
    t = t.withColumn("g", grams(F.col("w"))).withColumn("shared", F.array_intersect("g", F.lit(known)))
    none = F.array().cast("array<int>")
    for label, phrase in PHRASES.items():
        value, body = _starts(F.col("w"), phrase)
        t = t.withColumn(f"at_{label}", F.when(F.contains("t", F.lit(phrase.split()[-1])), F.transform(value, body)[0]).otherwise(none))
    places = F.filter(F.transform("g", lambda h, i: F.struct(h.alias("hash"), i.alias("pos"))), lambda x: F.array_contains("shared", x["hash"]))
    rows = t.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("w").cast("long").alias("n_words"), *[f"at_{x}" for x in PHRASES],
        F.when(F.size("shared") > 0, places).alias("places"), F.when(F.size("shared") > 0, F.col("w")).alias("w"),
    )
    rows = stash(rows, "license-rows")
    votes = rows.where("places IS NOT NULL").select("rid", F.inline("places")).join(F.broadcast(templates), "hash")
    lines = votes.groupBy("rid", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("label").alias("label"), F.first("ttext").alias("ttext"), F.first("size").alias("size"))
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int"), F.lit(0))
    merged = lines.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("rid", "template", "island", "label", "ttext", "size").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("d_lo"), F.max("diagonal").alias("d_hi"))
    spans = spans.where((F.col("votes") >= LEAST_VOTES) & (F.col("votes") * 2 >= F.least(F.col("size") - K + 1, F.lit(2 * LEAST_VOTES))))
    held = spans.join(rows.where("w IS NOT NULL").select("rid", "w"), "rid")
    begin = F.greatest(F.col("d_lo"), F.lit(0))
    span = F.array_join(F.slice("w", begin + 1, F.greatest(F.col("size") + F.col("d_hi") - F.col("d_lo"), F.lit(1))), " ")
    similar = 1 - F.levenshtein(span, F.col("ttext")) / F.greatest(F.length(span), F.length("ttext"))
    sure = held.select("rid", "label", similar.alias("similar")).where(F.col("similar") >= LEAST_SIMILARITY).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("similar").alias("similar"))
    at = F.concat(*[F.col(f"at_{x}") for x in PHRASES])
    base = F.filter(F.array(*[F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in PHRASES]), lambda x: x.isNotNull())
    joined = rows.select("rid", "doc_id", "n_words", at.alias("at"), base.alias("base")).join(sure, "rid", "left")
    both = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    return joined.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(both), ",").alias("labels"),
        F.coalesce("similar", F.when(F.size("at") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """Whole documents table."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
