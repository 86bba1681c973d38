"""Licence scan: Dice coefficient over word bigrams against licence templates, in DataFrame functions only.

The units compared are the lines of a text, the text as a whole, and, for licences that neither shows, runs of consecutive lines, so
a notice inside a document, a licence file and a notice wrapped over lines of a longer text are found. A unit is lower-cased and cut into
runs of letters, digits and dots. With b bigrams (as a set), a template of t bigrams can reach Dice d only if b lies between t * d / (2 - d)
and t * (2 - d) / d, and only if the two share so many bigrams that the unit holds one of a few anchor words; texts and lines without one
are told early. What is left meets the templates by an equi-join on bigrams.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm.base import let, materialize, named, row_keys

#: Notices by which licences are applied, in their published wording.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "apache-2.0-header": [(
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    )],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License."],
    "mit-text": [(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:"
    )],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "agpl-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "mpl-2.0": [(
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    )],
    "bsd": [(
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    )],
    "isc": [(
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    )],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: Whole licences, in their published wording, without copyright lines.
WHOLE = {
    "mit": (
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall "
        "be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY "
        "OF SUCH DAMAGE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0bsd": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE "
        "SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
        "altered from any source distribution."
    ),
    "bsl-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or "
        "organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and "
        "this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
        "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
        "solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE "
        "LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
        "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at "
        "large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE. For more information, please refer to http://unlicense.org/"
    ),
}
#: What texts are compared with: notices of a licence and its whole text.
TEMPLATES = {name: NOTICES.get(name, []) + [t for n, t in WHOLE.items() if n == name] for name in NOTICES | WHOLE}
#: The bigrams of all templates are broadcast; more than this many are refused.
MOST_TEMPLATE_BIGRAMS = 100_000


def normal_words(text: Column) -> Column:
    """Runs of letters, digits and dots without the dots at their ends; a run is read once, however many dots it has."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\.)(?:\.*+[a-z0-9]++)++"), F.lit(0))


def bigrams(text: Column) -> Column:
    """The set of word bigrams of the normalised text; of a text of one word, the word."""
    words = normal_words(text)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, words).otherwise(F.array_distinct(pairs))


def anchor_words(grams: list[list[str]], dice: float) -> list[str]:
    """Words of which every text within ``dice`` of a template holds one.

    Such a text shares at least dice / (2 - dice) of the template's bigrams. The words taken, longest first, touch so many of
    them that those left are too few.
    """
    found: set[str] = set()
    for own in grams:
        need, left = len(own) * dice / (2 - dice) - 1e-9, [g.split(" ") for g in own]
        for word in sorted({w for g in left for w in g}, key=lambda w: (-len(w), w)):
            if len(left) < need:
                break
            found.add(word)
            left = [g for g in left if word not in g]
    return sorted(found)


def templates(spark: SparkSession, texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    rows = [(name, f"{name}#{k}", text) for name, forms in texts.items() for k, text in enumerate(forms)]
    forms = spark.createDataFrame(rows, "license string, form string, _template string")
    return forms.select("license", "form", bigrams(F.col("_template")).alias("_grams"), F.size(normal_words(F.col("_template"))).alias("_words"))


def _runs(rows: DataFrame, known: DataFrame, found: DataFrame, dice: float) -> DataFrame:
    """``_id, _key, license, unit, dice`` of the best run of whole lines for each licence that is not among ``found``, with the line where it begins.

    The first and the last line of a run hold bigrams of the template, no further apart than the template's words, repeats too, allow within
    ``dice``. Bigrams of a run that the template lacks count as often as they stand. The places of a template's bigrams in a text are cut into
    blocks as long as a run may be, each with the places of the next, so what a run is chosen from is bounded by the template, not by the text.
    """

    def placed(line: Column, i: Column) -> Column:
        place = lambda ws: lambda w, j: F.struct((i + 1).alias("line"), j.alias("before"), (F.size(ws) - 1 - j).alias("after"), w.alias("w"))
        return let(normal_words(line), lambda ws: F.transform(ws, place(ws)))

    lines = F.transform(F.split("_text", "\n", -1), placed)
    words = rows.select("_id", "_key", F.flatten(lines).alias("_w")).where(F.size("_w") > 1)
    n = F.size("_w") - 1
    pair = lambda a, b: F.struct(a["line"].alias("line"), a["before"].alias("before"), b["after"].alias("after"), F.concat_ws(" ", a["w"], b["w"]).alias("gram"))
    pairs = F.zip_with(F.slice("_w", F.lit(1), n), F.slice("_w", F.lit(2), n), pair)
    places = words.select("_id", "_key", F.posexplode(pairs).alias("p", "x")).select("_id", "_key", "p", "x.line", "x.before", "x.after", F.col("x.gram").alias("_gram"))
    hits = places.join(known, "_gram")
    told = found.select(F.col("_id").alias("_fid"), F.col("_key").alias("_fkey"), F.col("license").alias("_flicense")).distinct()
    hits = hits.join(told, (hits["_key"] == told["_fkey"]) & (hits["license"] == told["_flicense"]) & hits["_id"].eqNullSafe(told["_fid"]), "left_anti")

    own = ["_id", "_key", "license", "form", "_t", "_reach"]
    in_order = Window.partitionBy(*own).orderBy("p")
    need = F.col("_t") * dice / (2 - dice) - 1e-9
    hits = hits.repartition(*own).withColumn("prev", F.coalesce(F.lag("p").over(Window.partitionBy(*own, "_gram").orderBy("p")), F.lit(-1)))
    hits = hits.withColumns({  # of a line only the first place can begin the best run, and only the last can end it
        "begins": F.coalesce(F.lag("line").over(in_order) != F.col("line"), F.lit(True)),
        "ends": F.coalesce(F.lead("line").over(in_order) != F.col("line"), F.lit(True)),
        "_kinds": F.sum((F.col("prev") < 0).cast("int")).over(Window.partitionBy(*own)),
    }).where(F.col("_kinds") >= need)
    block = F.floor(F.col("p") / F.col("_reach"))
    hits = hits.select(*own, "p", "line", "before", "after", "prev", "begins", "ends", block.alias("_own"), F.explode(F.array(block, block - 1)).alias("_block"))
    each = F.struct("p", "line", "before", "after", "prev", (F.col("begins") & (F.col("_own") == F.col("_block"))).alias("begins"), "ends")
    blocks = hits.groupBy(*own, "_block").agg(F.sort_array(F.collect_list(each)).alias("_hits"))

    def best_from(start: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            taken, shared = state["taken"] + 1, state["shared"] + (x["prev"] < start["p"]).cast("int")
            long = x["p"] + 1 + x["after"] - start["p"] + start["before"]  # bigrams of the whole lines
            score = 2 * shared / (F.col("_t") + shared + long - taken)
            return F.struct(taken.alias("taken"), shared.alias("shared"), F.greatest(state["best"], F.when(x["ends"], score).otherwise(0.0)).alias("best"))

        near = F.filter("_hits", lambda x: (x["p"] >= start["p"]) & (x["p"] < start["p"] + F.col("_reach")))
        nothing = F.struct(F.lit(0).alias("taken"), F.lit(0).alias("shared"), F.lit(0.0).alias("best"))
        return F.struct(F.aggregate(near, nothing, step, lambda state: state["best"]).alias("dice"), (-start["line"]).alias("u"))

    best = F.array_max(F.transform(F.filter("_hits", lambda x: x["begins"]), best_from))
    runs = blocks.select("_id", "_key", "license", best.alias("b")).where(F.col("b.dice") >= dice)
    runs = runs.groupBy("_id", "_key", "license").agg(F.max("b").alias("b"))
    return runs.select("_id", "_key", "license", (-F.col("b.u")).alias("unit"), "b.dice")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dice: float = 0.8, texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """A row for each document and licence found: the id, license, unit (number of the line from 1, 0 for the whole text), dice and ``_key``.

    Of several lines and the whole text the best counts, then the first; only where none of them shows the licence, the best run of lines does, and unit is the
    line where it begins. Null and empty texts and lines match nothing; null ids stay null; repeated rows give one row
    (``_key``, the hash of id and text, tells rows of one id apart); other columns are not looked at; no rows give no rows.
    """
    spark = docs.sparkSession
    forms = templates(spark, texts).withColumn("_reach", F.ceil(F.col("_words") * (2 - dice) / dice).cast("int"))
    grams = [r[0] for r in forms.select("_grams").collect()]
    if sum(map(len, grams)) > MOST_TEMPLATE_BIGRAMS:
        raise ValueError("too many templates to broadcast")
    most = math.ceil(max(map(len, grams)) * (2 - dice) / dice)
    known = F.broadcast(forms.select("license", "form", F.size("_grams").alias("_t"), "_reach", F.explode("_grams").alias("_gram")))
    anchors = F.array(*[F.lit(w) for w in anchor_words(grams, dice)])
    anchored = lambda c: F.arrays_overlap(normal_words(F.col(c)), anchors)

    rows = docs.select(*row_keys(id_col, text_col), F.coalesce(named(text_col), F.lit("")).alias("_text")).where(anchored("_text"))
    units = rows.select("_id", "_key", F.posexplode(F.concat(F.array("_text"), F.split("_text", "\n", -1))).alias("unit", "_unit")).where(anchored("_unit"))
    units = units.where(F.size(F.array_distinct(normal_words(F.col("_unit")))) <= most + 1)  # a set of b bigrams has b + 1 words at most
    units = units.select("_id", "_key", "unit", bigrams(F.col("_unit")).alias("_grams")).withColumn("_n", F.size("_grams")).where(F.col("_n").between(1, most))
    shared = units.select("_id", "_key", "unit", "_n", F.explode("_grams").alias("_gram")).join(known.drop("_reach"), "_gram")
    bound = 2 * F.least("_n", "_t") / (F.col("_n") + F.col("_t")) >= dice  # the most that sizes allow
    hits = shared.where(bound).groupBy("_id", "_key", "unit", "license", "form").agg((2 * F.count_distinct("_gram") / F.first(F.col("_n") + F.col("_t"))).alias("dice")).where(F.col("dice") >= dice)
    hits = materialize(hits.select("_id", "_key", "license", "unit", "dice"), "license-units")
    hits = hits.withColumn("own", F.lit(1)).unionByName(_runs(rows, known, hits, dice).withColumn("own", F.lit(0)))
    best = hits.groupBy("_id", "_key", "license").agg(F.max(F.struct("own", "dice", (-F.col("unit")).alias("u"))).alias("b"))
    return best.select(F.col("_id").alias(id_col), "license", (-F.col("b.u")).alias("unit"), F.col("b.dice").alias("dice"), "_key")
