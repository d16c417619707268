"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them;
DataFrame functions only.

Text and templates are cut into 5-word shingles (a template of fewer words: one shingle of all). For every template length
there are windows of as many words at every start. A window has ``BANDS`` bands of ``ROWS`` minhashes. A window that holds
at least ``share`` = 0.8 of a template's shingles has a Jaccard similarity J >= 0.8 / 1.2 = 2/3 with it, so some band
agrees with a probability of at least 1 - (1 - J^2)^16 = 1 - 8e-5; a whole template always collides.

Only windows that can hold enough are hashed: a window with k shingles of a template holds k places of such shingles in a
row, no further apart than the template is long. Places are found with a fixed-size bitmap, then exactly. Hits are
verified on the words, not on hashes of them.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Null and empty texts have none and
match nothing; templates without words are left out. Rows that share an id are told apart by their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common
from tracemill.llm.decontam import words_of

SIZE = 5
ROWS, BANDS = 2, 16
SHARE = (4, 5)            # least containment
BITS = 20
SALTS = 8

# Short license notices as they stand in public files.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


# Whole texts of short licences and standard headers of long ones. The headers of the GNU licences share
# most shingles: the sentence that names the licence tells them apart (any version), the rest is "GNU-header".
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
     "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
     "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
     "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
     "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
     "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
     "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
     "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
     "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
     "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
     "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
     "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
     "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
     "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, "
     "and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
     "you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
     "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
     "the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
     "implied. See the License for the specific language governing permissions and limitations under the License."),
    *[(name, f"under the terms of the GNU {kind}General Public License as published by the Free Software Foundation")
      for name, kind in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero "))],
    ("GNU-header", "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, "
     "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
     "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
     "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES + TEXTS, "license string, text string")


def shingles(words: Column) -> Column:
    """The shingles of an array of words, as arrays; all of them as one if there are fewer than SIZE."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<array<string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - SIZE + 1, F.lit(1))), lambda i: F.slice(words, i, F.lit(SIZE))))


def bands(items: Column) -> Column:
    """(band, key) of a set of shingles. The j-th minhash is the least of the shingles' hashes with the seed j."""
    hashed = F.transform(items, lambda s: F.xxhash64(s))

    def seeded(j: int):
        return lambda h: F.xxhash64(F.lit(j), h)
    least = [F.array_min(F.transform(hashed, seeded(j))) for j in range(ROWS * BANDS)]
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*least[b * ROWS:(b + 1) * ROWS]).alias("key")) for b in range(BANDS)])


def prepared(templates: DataFrame, license_col: str, text_col: str) -> DataFrame:
    """(license, n, items): distinct templates, their words' number and their distinct shingles."""
    rows = templates.select(F.col(license_col).cast("string").alias("license"), words_of(F.col(text_col).cast("string")).alias("words"))
    rows = rows.where("size(words) > 0 AND license IS NOT NULL").distinct()
    return rows.select("license", F.size("words").alias("n"), F.array_distinct(shingles(F.col("words"))).alias("items"))


def _spots(docs: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """(doc, tid, n, starts): where windows of n words may hold enough of a template with shingles of ``width`` words."""
    table = common.bit_table(known.select(F.explode("items").alias("s")).select(F.xxhash64("s").alias("key")), "key", BITS)
    keyed = common.rows_keyed(docs, tid_bits=64).select("doc", "tid", words_of(F.col("text")).alias("words"))
    each = keyed.select("doc", "tid", "words", F.posexplode("words").alias("pos", "word"))
    gram = F.slice("words", F.col("pos") + 1, F.lit(width))
    hits = each.where((F.col("pos") + width <= F.size("words")) & common.has_bit(table, F.xxhash64(gram), BITS)).select("doc", "tid", "pos", gram.alias("gram"))
    least = F.expr(f"(size(items) * {SHARE[0]} + {SHARE[1] - 1}) div {SHARE[1]}").cast("int")
    grams = known.select("license", "n", F.xxhash64("license", "items").alias("template"), least.alias("least"), F.explode("items").alias("gram"))
    per = hits.join(grams, "gram").groupBy("doc", "tid", "template", "n", "least").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    per = per.where(F.size("at") >= F.col("least"))
    room = F.col("n") - width

    def reach(i: Column) -> Column:
        first, last = F.get("at", i), F.get("at", i + F.col("least") - 1)
        return F.when(last - first <= room, F.sequence(F.greatest(last - room, F.lit(0)), first)).otherwise(F.array().cast("array<int>"))
    starts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("least")), reach))
    return per.select("doc", "tid", "n", F.array_distinct(starts).alias("starts")).where("size(starts) > 0")


def scan(docs: DataFrame, templates: DataFrame, license_col: str = "license", text_col: str = "text") -> DataFrame:
    """(doc, tid, license, start, n, shared, items): every window that holds enough of a template, verified."""
    known = common.saved(prepared(templates, license_col, text_col), "templates")
    index = known.select("license", "n", "items", F.explode(bands(F.col("items"))).alias("b")).select("license", "n", "items", "b.band", "b.key")
    # short templates are one shingle of their own width
    widths = [r["w"] for r in known.select(F.least(F.col("n"), F.lit(SIZE)).alias("w")).distinct().orderBy("w").collect()]
    spots = None
    for width in widths:
        some = _spots(docs, known.where(F.least(F.col("n"), F.lit(SIZE)) == width), width)
        spots = some if spots is None else spots.unionByName(some)
    if spots is None:
        return docs.sparkSession.createDataFrame([], "doc long, tid long, license string, start int, n int, shared int, items int")
    spots = common.saved(spots, "spots")
    # only rows with a spot send their words
    table = common.bit_table(spots.select(F.xxhash64("doc", "tid").alias("key")), "key", BITS)
    keyed = common.rows_keyed(docs, tid_bits=64).where(common.has_bit(table, F.xxhash64("doc", "tid"), BITS)).select("doc", "tid", words_of(F.col("text")).alias("words"))
    windows = keyed.join(spots, ["doc", "tid"]).select("doc", "tid", "words", F.col("n").alias("len"), F.explode("starts").alias("start")).select(
        "doc", "tid", "start", "len", F.slice("words", F.col("start") + 1, F.col("len")).alias("window")).where("size(window) = len").distinct()
    banded = windows.select("doc", "tid", "start", "len", F.array_distinct(shingles(F.col("window"))).alias("set")).select(
        "doc", "tid", "start", "len", "set", F.explode(bands(F.col("set"))).alias("b")).select("doc", "tid", "start", "len", "set", "b.band", "b.key")
    met = banded.join(index.withColumnRenamed("n", "len"), ["len", "band", "key"])
    shared = F.size(F.array_intersect("set", "items"))
    return met.where(shared * SHARE[1] >= F.size("items") * SHARE[0]).select(
        "doc", "tid", "license", "start", F.col("len").alias("n"), shared.alias("shared"), F.size("items").alias("items")).distinct()


def licensed(docs: DataFrame, templates: DataFrame, license_col: str = "license", text_col: str = "text") -> DataFrame:
    """doc_id, licenses (sorted, comma-joined), n_windows, first_start, best_share for every row; best_share is the largest
    containment, null without a hit."""
    hits = scan(docs, templates, license_col, text_col)
    per = hits.groupBy("doc", "tid").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count(F.lit(1)).alias("n_windows"),
                                         F.min("start").cast("bigint").alias("first_start"), F.max(F.col("shared") / F.col("items")).alias("best_share"))
    rows = common.rows_keyed(docs, tid_bits=64).select("doc", "tid").join(common.saved(per, "licenses"), ["doc", "tid"], "left")
    return rows.select(F.when(F.col("doc") != 2 ** 63 - 1, F.col("doc")).alias("doc_id"), F.coalesce("licenses", F.lit("")).alias("licenses"),
                       F.coalesce("n_windows", F.lit(0)).cast("bigint").alias("n_windows"), "first_start", "best_share")
