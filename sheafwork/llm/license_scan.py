"""Licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

A document is scanned as a whole, by paragraph (parted by blank lines) and by line. The words of a unit (letters and
digits, in lower case) are compared with each template's: twice the bigrams that both have, over the bigrams of either,
counted with repeats. Sizes bound the coefficient, so a unit is compared only with templates whose number of bigrams
allows the threshold, and its bigrams aren't formed if there is none.

A null or empty text and a unit of fewer than two words match nothing. A document of one paragraph has none but the
whole, one of one line no lines. Repeated rows are reported each, also those with a null id. Texts are read whole, whatever
their length; an empty table gives no rows; of templates with equal coefficients the first counts. Other columns aren't
read and may have any name.

scan_windows finds notices wherever they stand, also over several lines or paragraphs and inside a sentence: it takes
every run of words of a document for a unit. Its work on a document that holds a template grows with the square of that
template's length, so it is for notices.

Full licence texts come from a folder of text files (templates_in), which scan compares with whole texts, paragraphs and
lines. Templates are a table of bounded size, measured before it goes to every executor; only their sizes, and for
windows their bigrams up to MARKED_BIGRAMS, come to the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.llm import scratch
from sheafwork.llm.decontam import by_key

THRESHOLD = 0.8
#: Rows of templates' bigrams up to which windows' documents are first tested for words that no match can do without.
MARKED_BIGRAMS = 1_000_000

#: Short notices and licence texts by their usual identifiers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/.",
    ),
)


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. ",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. ",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
#: For windows; the units' templates are part of their query's SQL.
WINDOW_TEMPLATES = (
    *TEMPLATES,
    ("BSD-2-Clause", _BSD[0] + _BSD[2]),
    ("BSD-3-Clause", "".join(_BSD)),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software "
        "Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser "
        "General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, "
        "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser "
        "General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero "
        "General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act "
        "of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
        "and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of "
        "machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR "
        "ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
)


def words(text: Column) -> Column:
    """array<string>: runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(w: Column) -> Column:
    """array<string>: each two neighbouring words, with repeats."""
    return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def of_texts(texts: DataFrame) -> DataFrame:
    """(template, licence, size, bigram, n): of texts' (template, licence, text), the bigrams and how often each has them."""
    each = texts.select("template", "licence", words(F.col("text")).alias("w")).where("size(w) > 1")
    found = each.select("template", "licence", (F.size("w") - 1).alias("size"), F.explode_outer(bigrams(F.col("w"))).alias("bigram"))
    return found.groupBy("template", "licence", "size", "bigram").agg(F.count(F.lit(1)).alias("n"))


def templates(spark: SparkSession, texts: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """The bigrams, as of_texts, of (licence, text), numbered from 0."""
    rows = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("text")) for k, (name, text) in enumerate(texts)))
    return of_texts(spark.range(1).select(F.explode(rows).alias("t")).select("t.*"))


def templates_in(spark: SparkSession, folder: str, first: int = len(WINDOW_TEMPLATES)) -> DataFrame:
    """The bigrams, as of_texts, of a folder's text files: a licence is named as its file without .txt or .md. They are
    numbered from first in the order of their names, so that they can be united with templates(). A file of fewer than
    two words is no template."""
    files = spark.read.text(folder, wholetext=True).select("_metadata.file_path", "_metadata.file_name", F.col("value").alias("text"))
    files = scratch.stored(files, "licence-files")
    order = Window.orderBy("file_name", "file_path")  # of names alone
    named = files.select("file_path", "file_name").withColumn("template", (F.row_number().over(order) + (first - 1)))
    licence = F.regexp_replace("file_name", r"(?i)\.(txt|md)$", "").alias("licence")
    return scratch.stored(of_texts(named.join(files.select("file_path", "text"), "file_path").select("template", licence, "text")), "licence-bigrams")


def size_ranges(sizes: list[int], threshold: float) -> list[tuple[float, float]]:
    """Ranges, apart from each other, of the numbers of bigrams with which a unit can match a template of one of the sizes."""
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    out: list[tuple[float, float]] = []
    for low, high in sorted((least * size, most * size) for size in sizes):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, kind, place, w): the units of each document and their words; kind is text, paragraph or line. row
    tells documents' rows apart."""
    body = F.col("text")
    none = F.array().cast("array<struct<kind:string,place:int,w:array<string>>>")

    def parts(kind: str, pieces: Column) -> Column:
        return F.transform(pieces, lambda w, k: F.struct(F.lit(kind).alias("kind"), k.alias("place"), w.alias("w")))

    def of_lines(lines: Column) -> Column:
        """A word spans no line end, so the lines' words are the whole text's."""
        return F.concat(parts("text", F.array(F.flatten(lines))), F.when(F.size(lines) > 1, parts("line", lines)).otherwise(none))

    # Words are formed once, before the rows are exploded: a projection of them would be copied into each test of them.
    lines = F.transform(F.split(body, r"\r?\n|\r"), words)
    found = F.flatten(F.transform(F.array(lines), of_lines))
    break_ = r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)"
    paragraphs = F.filter(F.array(F.transform(F.split(body, break_ + r"\s*"), words)), lambda p: F.size(p) > 1)
    found = F.concat(found, F.when(body.rlike(break_), F.flatten(F.transform(paragraphs, lambda p: parts("paragraph", p)))).otherwise(none))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(body.isNotNull())
    each = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode_outer(found).alias("u"))
    return each.select("doc_id", "row", "u.kind", "u.place", "u.w")


def scan(docs: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, place, licence, shared, unit_size, template_size, dice): the units that match a template, each
    with its best one (ties: the first template)."""
    known = templates(docs.sparkSession) if known is None else known
    # shared <= the smaller size, so the coefficient is at most 2 * smaller / (smaller + larger).
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [r[0] for r in known.select("size").distinct().collect()]
    n = F.size("w") - 1
    allowed = F.lit(False)
    for low, high in size_ranges(sizes, threshold):
        allowed = allowed | n.between(low, high)
    fit = units(docs, doc_id, text).where((F.size("w") > 1) & allowed)
    own = fit.select("doc_id", "row", "kind", "place", n.alias("unit_size"), F.explode_outer(bigrams(F.col("w"))).alias("bigram"))
    met = by_key(own, known, "bigram").where((F.col("unit_size") >= least * F.col("size")) & (F.col("unit_size") <= most * F.col("size")))
    place = ["doc_id", "row", "kind", "place", "unit_size", "template", "licence", "size"]
    counted = met.groupBy(*place, "bigram", "n").agg(F.count(F.lit(1)).alias("times"))
    both = counted.groupBy(*place).agg(F.sum(F.least("times", "n")).alias("shared"))
    dice = 2 * F.col("shared") / (F.col("unit_size") + F.col("size"))
    scored = both.withColumn("dice", dice).where(F.col("dice") >= threshold)
    best = F.max(F.struct("dice", (-F.col("template")).alias("order"), "licence", "shared", "unit_size", F.col("size").alias("template_size"))).alias("b")
    return scored.groupBy("doc_id", "row", "kind", "place").agg(best).select(
        "doc_id", "kind", "place", "b.licence", "b.shared", "b.unit_size", "b.template_size", "b.dice"
    )


#: Words that many texts have, taken last.
_COMMON = frozenset("a all an and any as at be by for free if in is it may more no not of on or other that the this to under use will with without work you".split())


def markers(known: list[tuple[int, int, str, int]], threshold: float) -> list[str]:
    """Words of which every window at the threshold has one, of (template, size, bigram, n): so many of a template's
    bigrams have one of its longest words, common ones last, that no match can do without all of them."""
    found, of = set(), defaultdict(dict)
    for template, size, bigram, n in known:
        of[template, size][bigram] = n
    for (_, size), grams in of.items():
        spare = size - math.ceil(threshold / (2 - threshold) * size - 1e-9)
        left, having, met = dict(grams), defaultdict(list), 0
        for b in grams:
            for word in {*b.split(" ")}:
                having[word].append(b)
        for word in sorted(having, key=lambda w: (w in _COMMON, -len(w), w)):
            if met > spare:
                break
            found.add(word)
            met += sum(left.pop(b, 0) for b in having[word])
    return sorted(found)


def scan_windows(docs: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, place, licence, shared, unit_size, template_size, dice): kind is window, place its first word, from
    0. Of the windows that match a template, those with the most shared bigrams (ties: the greater coefficient, the
    first template, the first place, the shorter one), none over another.

    A best window starts and ends at a bigram of its template. From each one that can start a match, the coefficient is
    formed at each one after it as far as sizes allow. A repeated bigram counts as often as the template has it, that is
    unless the n-th before it is in the window too."""
    known = templates(docs.sparkSession, WINDOW_TEMPLATES) if known is None else known
    marked = None
    if known.count() <= MARKED_BIGRAMS:
        marks = markers([tuple(r) for r in known.select("template", "size", "bigram", "n").collect()], threshold)
        marked = F.array(*map(F.lit, marks)) if marks else F.array().cast("array<string>")
    may_match = lambda w: F.lit(True) if marked is None else F.arrays_overlap(w, marked)
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    # As in units, words are formed once; documents without a marker have no bigrams here.
    grams = F.flatten(F.transform(F.filter(F.array(words(F.col("text"))), lambda w: (F.size(w) > 1) & may_match(w)), bigrams))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    own = rows.select("doc_id", "row", F.posexplode_outer(grams).alias("pos", "bigram"))
    of = ["doc_id", "row", "template", "licence", "size"]
    met = by_key(own, known, "bigram").repartition("doc_id", "row")

    def hits(places: Column) -> Column:
        """(pos, before): before is the n-th place before pos, null if there is none."""
        earlier = lambda k: F.when(k >= F.col("n"), F.get(places, (k - F.col("n")).cast("int")))
        return F.transform(places, lambda x, k: F.struct(x.alias("pos"), earlier(k).alias("before")))

    sorted_ = met.groupBy(*of, "bigram", "n").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    each = sorted_.select(*of, F.flatten(F.transform(F.array("p"), hits)).alias("h"))
    lists = each.groupBy(*of).agg(F.array_sort(F.flatten(F.collect_list("h"))).alias("h"))
    need = F.ceil(least * F.col("size") - 1e-9).cast("int")
    span = F.floor(most * F.col("size") + 1e-9).cast("int")
    start = "struct<shared:bigint,pos:int,best:bigint,last:int,dice:double>"

    def windows(h: Column) -> Column:
        def at(k: Column) -> Column:
            return F.get(h, k)["pos"]

        def best(k: Column) -> Column:
            first = at(k)

            def step(a: Column, x: Column) -> Column:
                shared = a["shared"] + F.when(x["before"] >= first, 0).otherwise(1)
                unit = x["pos"] - first + 1
                dice = 2 * shared / (unit + F.col("size"))
                more = (unit <= span) & (dice >= threshold) & (F.struct(shared, dice) > F.struct(a["best"], a["dice"]))
                return F.struct(
                    shared.alias("shared"), x["pos"].alias("pos"), F.when(more, shared).otherwise(a["best"]).alias("best"),
                    F.when(more, x["pos"]).otherwise(a["last"]).alias("last"), F.when(more, dice).otherwise(a["dice"]).alias("dice"),
                ).cast(start)

            none = F.struct(F.lit(0).alias("shared"), F.lit(-1).alias("pos"), F.lit(0).alias("best"), F.lit(-1).alias("last"), F.lit(0.0).alias("dice"))
            run = F.aggregate(F.slice(h, k + 1, span), none.cast(start), step)
            return F.struct(first.alias("first"), run.alias("run"))

        able = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda k: F.coalesce(at(k + need - 1) - at(k) < span, F.lit(False)))
        return F.filter(F.transform(able, best), lambda w: w["run"]["best"] > 0)

    found = lists.select(*of, F.explode_outer(F.flatten(F.transform(F.array("h"), windows))).alias("w")).where("w IS NOT NULL")
    whole = F.struct(
        (-F.col("w.run.best")).alias("shared"), (-F.col("w.run.dice")).alias("dice"), "template",
        F.col("w.first").alias("first"), F.col("w.run.last").alias("last"), "licence", "size",
    )
    all_of = found.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(whole)).alias("all"))
    kind = all_of.schema["all"].dataType.simpleString()

    def apart(taken: Column, w: Column) -> Column:
        over = F.exists(taken, lambda t: (t["first"] <= w["last"]) & (w["first"] <= t["last"]))
        return F.when(over, taken).otherwise(F.concat(taken, F.array(w)))

    out = all_of.select("doc_id", F.explode_outer(F.aggregate("all", F.array().cast(kind), apart)).alias("w"))
    return out.select(
        "doc_id", F.lit("window").alias("kind"), F.col("w.first").alias("place"), "w.licence", (-F.col("w.shared")).alias("shared"),
        (F.col("w.last") - F.col("w.first") + 1).alias("unit_size"), F.col("w.size").alias("template_size"), (-F.col("w.dice")).alias("dice"),
    )
