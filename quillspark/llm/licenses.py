"""License scans: normalised segments against license templates by Dice coefficient over word bigrams.

A segment is a line, a paragraph (between blank lines) or the whole text. It is normalised (lower case,
runs of other than letters and digits to one space) and becomes the set of its word bigrams. A template
of m bigrams can reach the threshold t with a segment of n bigrams only if
n between m * t / (2 - t) and m * (2 - t) / t; templates outside are not compared. Everything is built-in
functions; the templates are a fixed list, so they ride in the plan as literals.

What reaches the threshold shares m * t / (2 - t) bigrams with the template at least, so it has one of any
more than m * (1 - t / (2 - t)) of them: the template's anchors, those with the longest words. Texts without an anchor, by its
more telling word first, are left aside after one look at their words; the others are written once and compared.

Notices inside a longer segment are met by windows of a template's size over the words of the whole text,
laid where one of the template's anchors has its place. Of windows that overlap the one
furthest above the threshold counts, by bigrams, so that a part of a text doesn't hide the whole; a license that a segment has too keeps the segments' figures.

Defined results: null and empty texts, and texts without two words in a segment, give no licenses; of templates with equal
Dice on a segment the first by name is its license; a text has each license once, with its
best Dice over segments; repeated rows give repeated results; a text of any length is compared whole; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let
from quillspark.llm.shared import read, stage_table

THRESHOLD = 0.8

# License notices, and texts and headers as their stewards publish them, without the copyright line; several wordings may share a name.
# The texts of many pages (GPL, LGPL, AGPL, Apache, MPL, Creative Commons) are known by their notices and headers.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("GPL-2.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    ("GPL-2.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.'),
    ("LGPL-2.1", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.'),
    ("LGPL-2.1", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.'),
    ("GPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("LGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.'),
    ("LGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.'),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("GPL-2.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.'),
    ("LGPL-2.1", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.'),
]
# Words that most texts have.
USUAL = frozenset("a all and any are as at be but by for from has have if in is it its may not of on or other out shall such that the there these this to under use was were which will with you your".split())
# End of fixed values.

NOT_WORD = "[^\\p{L}\\p{N}]+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(m: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a segment that can reach threshold with a template of m: 2 * min / (n + m) must."""
    sizes = [n for n in range(1, int(m * (2 - threshold) / threshold) + 2) if 2 * min(n, m) >= threshold * (n + m)]
    return sizes[0], sizes[-1]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Neighbouring words, joined; empty with fewer than two."""
    last = lambda own: F.greatest(F.size(own) - 1, F.lit(0))
    return let(words, lambda own: F.zip_with(F.slice(own, F.lit(1), last(own)), F.slice(own, F.lit(2), last(own)), lambda a, b: F.concat_ws(" ", a, b)))


def _ordered_pairs(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in itertools.pairwise(words)]


def _telling(bigram: str) -> tuple[int, str]:
    """Letters of the longest of its words that isn't usual, and the word; of usual words alone, none."""
    own = max(bigram.split(), key=lambda w: (w not in USUAL, len(w), w))
    return (0 if own in USUAL else len(own)), own


def anchor_bigrams(threshold: float = THRESHOLD) -> list[set[str]]:
    """Of each template, bigrams of which whatever reaches the threshold has one at least: those with the longest words first."""
    out = []
    for _, text in TEMPLATES:
        own = sorted(template_bigrams(text), key=lambda b: (-_telling(b)[0], b))
        out.append(set(own[: int(len(own) * (1 - threshold / (2 - threshold)) + 1e-9) + 1]))
    return out


def anchors(threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """(bigram, template, bigrams before it) of each anchor, at all of its places."""
    return [(b, k, i) for k, ((_, text), own) in enumerate(zip(TEMPLATES, anchor_bigrams(threshold), strict=True)) for i, b in enumerate(_ordered_pairs(text)) if b in own]


def telling_words(threshold: float = THRESHOLD) -> list[str]:
    """Words of which each anchor has one."""
    return sorted({_telling(b)[1] for own in anchor_bigrams(threshold) for b in own})


def candidate_texts(df: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(row, id, text) of the texts with an anchor, written: no other has anything to compare."""
    telling, known = telling_words(threshold), sorted(set().union(*anchor_bigrams(threshold)))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = rows.where(F.exists(F.split(F.lower("text"), NOT_WORD), lambda w: w.isin(telling))).where(F.exists(_pairs(_words(F.col("text"))), lambda b: b.isin(known)))
    return stage_table(own, "license-candidates")


def license_segments(texts: DataFrame, threshold: float) -> DataFrame:
    """(row, id, bigrams) of every segment that has an anchor."""
    text = F.col("text")
    lines, paragraphs = F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n")
    none = F.array().cast("array<string>")
    segments = F.concat(lines, let(paragraphs, lambda own: F.when(F.size(own) > 1, F.filter(own, lambda p: F.instr(p, "\n") > 0)).otherwise(none)), F.when(F.instr(text, "\n") > 0, F.array(text)).otherwise(none))
    known = sorted(set().union(*anchor_bigrams(threshold)))
    rows = texts.select("row", "id", F.explode(segments).alias("segment")).select("row", "id", F.array_distinct(_pairs(_words(F.col("segment")))).alias("bigrams"))
    return rows.where(F.arrays_overlap("bigrams", F.array(*map(F.lit, known))))


def _best(bigrams: Column, threshold: float) -> Column:
    """(dice, name) of the segment's best template at or above threshold; null if there is none."""
    n = F.size(bigrams)
    scores = []
    for name, text in TEMPLATES:
        own = template_bigrams(text)
        low, high = size_bounds(len(own), threshold)
        dice = F.size(F.array_intersect(bigrams, F.array(*map(F.lit, own)))) * F.lit(2.0) / (n + len(own))
        scores.append(F.when(n.between(low, high), F.struct((-dice).alias("minus"), F.lit(name).alias("name"))))
    return F.least(*scores)


def window_licenses(texts: DataFrame, threshold: float) -> DataFrame:
    """(row, id, license, dice) by windows of a template's size over the whole text: of windows that overlap only the best counts."""
    known = anchors(threshold)
    pairs = _pairs(_words(F.col("text")))
    marked = F.filter(F.transform(pairs, lambda b, i: F.struct(b.alias("bigram"), i.alias("i"))), lambda x: x["bigram"].isin(sorted({b for b, *_ in known})))
    index = F.broadcast(texts.sparkSession.createDataFrame(known, "bigram string, k int, before int"))
    # texts stay out of the exploded rows: places of windows are gathered for each text, and each text is read again with its own
    hits = texts.select("row", F.explode(marked).alias("x")).join(index, F.col("x.bigram") == F.col("bigram"))
    places = hits.groupBy("row").agg(F.collect_set(F.struct("k", F.greatest(F.col("x.i") - F.col("before"), F.lit(0)).alias("start"))).alias("places"))
    templates = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, template_bigrams(t))).alias("own"), F.lit(len(_ordered_pairs(t))).alias("m")) for name, t in TEMPLATES))

    def compared(place, own):
        def scored(t):
            w = F.array_distinct(F.slice(own, place["start"] + 1, t["m"]))
            dice = let(w, lambda x: F.size(F.array_intersect(x, t["own"])) * F.lit(2.0) / (F.size(x) + F.size(t["own"])))
            return let(dice, lambda d: F.struct((t["m"] * (threshold - d)).alias("minus"), t["name"].alias("name"), place["start"].alias("start"), (place["start"] + t["m"]).alias("end"), d.alias("dice")))

        return let(F.get(templates, place["k"]), scored)

    both = texts.join(places, "row").select("row", "id", "places", pairs.alias("pairs"))
    listed = both.select("row", "id", F.array_sort(F.filter(let(F.col("pairs"), lambda own: F.transform("places", lambda x: compared(x, own))), lambda x: x["dice"] >= threshold)).alias("all"))
    none = F.array().cast("array<struct<minus: double, name: string, start: int, end: int, dice: double>>")
    best = F.aggregate("all", none, lambda kept, x: F.when(F.exists(kept, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), kept).otherwise(F.concat(kept, F.array(x))))
    one = listed.select("row", "id", F.explode(best).alias("best"))
    return one.groupBy("row", "id", F.col("best.name").alias("license")).agg(F.max("best.dice").alias("dice"))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, segments) for each license of each row: its best Dice and the number of segments that have it; 0 segments if only a window has it."""
    texts = candidate_texts(df, id_col, text_col, threshold)
    found = license_segments(texts, threshold).select("row", "id", _best(F.col("bigrams"), threshold).alias("best"))
    found = found.where(F.col("best.minus") <= -threshold)
    per = found.select("row", "id", F.col("best.name").alias("license"), (-F.col("best.minus")).alias("dice"), F.lit(1).alias("segments"))
    both = per.unionByName(window_licenses(texts, threshold).withColumn("segments", F.lit(0)))
    whole = F.sum("segments")
    every = both.groupBy("row", "id", "license").agg(F.coalesce(F.max(F.when(F.col("segments") > 0, F.col("dice"))), F.max("dice")).alias("dice"), whole.alias("segments"))
    return every.select(F.col("id").alias("doc_id"), "license", F.round("dice", 6).alias("dice"), "segments")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def oracle() -> str:
    rows = ",\n    ".join(f"({k}, '{name}', {len(_ordered_pairs(text))}, {_sql_list(template_bigrams(text))})" for k, (name, text) in enumerate(TEMPLATES))
    places = ", ".join(f"('{b}', {k}, {i})" for b, k, i in anchors())
    return rf"""
WITH templates(k, name, m, grams) AS (VALUES
    {rows}),
anchors(bigram, k, before) AS (VALUES {places}),
parts AS (
    SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines,
        string_split_regex(coalesce(text, ''), '\n[ \t\r]*\n') AS paragraphs
    FROM documents),
segments AS (
    SELECT doc, unnest(list_concat(lines,
        CASE WHEN len(paragraphs) > 1 THEN list_filter(paragraphs, lambda p: contains(p, chr(10))) ELSE [] END,
        CASE WHEN len(lines) > 1 THEN [text] ELSE [] END)) AS segment
    FROM parts),
words AS (
    SELECT doc, row_number() OVER () AS seg, list_filter(string_split_regex(lower(segment), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM segments),
grams AS (
    SELECT doc, seg, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
scored AS (
    SELECT doc, seg, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM grams, templates
    WHERE 2 * least(len(g), len(grams)) >= {THRESHOLD}::DOUBLE * (len(g) + len(grams))),
best AS (
    SELECT doc, seg, name, dice FROM scored WHERE dice >= {THRESHOLD}::DOUBLE
    QUALIFY row_number() OVER (PARTITION BY seg ORDER BY dice DESC, name) = 1),
texts AS (
    SELECT doc, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g
    FROM (SELECT doc, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM parts)),
pairs AS (SELECT doc, unnest(g) AS bigram, unnest(range(0, len(g))) AS i FROM texts),
windows AS (SELECT DISTINCT doc, k, greatest(i - before, 0) AS start FROM pairs JOIN anchors USING (bigram)),
compared AS (
    SELECT doc, name, start, start + m AS stop, m, list_distinct(g[start + 1:start + m]) AS own, grams FROM windows JOIN texts USING (doc) JOIN templates USING (k)),
near AS (SELECT doc, name, start, stop, m, 2.0::DOUBLE * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice FROM compared),
listed AS (
    SELECT doc, list({{'name': name, 'start': start, 'stop': stop, 'dice': dice}} ORDER BY m * ({THRESHOLD}::DOUBLE - dice), name, start, stop, dice) AS every
    FROM near WHERE dice >= {THRESHOLD}::DOUBLE GROUP BY doc),
apart AS (
    SELECT doc, unnest(list_reduce(list_transform(every, lambda x: [x]), lambda kept, x:
        CASE WHEN len(list_filter(kept, lambda y: x[1].start < y.stop AND y.start < x[1].stop)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS one FROM listed),
both_ AS (
    SELECT doc, name, max(dice) AS dice, count(*) AS segments FROM best GROUP BY doc, name
    UNION ALL SELECT doc, one.name, max(one.dice), 0 FROM apart GROUP BY doc, one.name)
SELECT doc_id, name AS license, round(coalesce(max(b.dice) FILTER (segments > 0), max(b.dice)), 6) AS dice, sum(segments)::BIGINT AS segments
FROM both_ b JOIN parts USING (doc) GROUP BY doc, doc_id, name
"""
