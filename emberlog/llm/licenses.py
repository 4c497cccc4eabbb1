"""Licence scans by Dice coefficient over word bigrams (native).

Lines, paragraphs and the whole text of a document are normalised (lower case,
runs of other characters than letters and digits become one blank) and held
against licence templates.  Paragraphs end at lines without words, such as
those of a comment, and at the end of a comment.  Two bigram sets of sizes a
and b cannot reach a Dice coefficient t unless b lies between a*t/(2-t) and
a*(2-t)/t, which prunes units and templates before any sets are compared.

Before that, texts and units without any marker word are passed over.  The
markers are chosen from the templates so that what is left of a template
without them is too small a part of it to reach the threshold: nothing is lost.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

THRESHOLD = 0.8

# Public licence notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: Between paragraphs: lines without words, ends of comments.
PARAGRAPH = r"\n[ \t\r\n*#/;%-]*\n|\*/"
# Words that are too common to be markers.
_COMMON = frozenset("a an and any as at be but by for from in is it its mit not of on or other that the this to under use used with without you".split())


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    w = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes of bigram sets that can reach the threshold with one of n."""
    low, high = n * threshold / (2 - threshold), n * (2 - threshold) / threshold
    return -int(-(low - 1e-9) // 1), int(high + 1e-9)


def markers(grams: list[list[str]], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with one of ``grams`` has one."""
    open_, chosen = [(g, len(g)) for g in grams], []
    while open_ := [(g, m) for g, m in open_ if g and 2 * len(g) >= (threshold - 1e-9) * (len(g) + m)]:
        hits: dict[str, int] = {}
        for g, _ in open_:
            for w in {w for x in g for w in x.split(" ")}:
                hits[w] = hits.get(w, 0) + sum(w in x.split(" ") for x in g)
        best = max(hits, key=lambda w: (w not in _COMMON, hits[w], len(w), w))
        chosen.append(best)
        open_ = [([x for x in g if best not in x.split(" ")], m) for g, m in open_]
    return chosen


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: id, license_id, dice, licenses, n_matches.

    ``license_id`` is the best licence (highest Dice, then its name), null if
    none reaches the threshold; ``licenses`` lists all found, sorted;
    ``n_matches`` counts lines that match.  A unit may have any length: only
    its distinct bigrams count.  Null and empty texts match nothing.  Repeated
    rows each give a row.  Nothing shuffles.  Bigrams are compared by 64-bit
    hashes.
    """
    grams = [(name, g) for name, t in templates if (g := template_bigrams(t))]
    bounds = [size_bounds(len(g), threshold) for _, g in grams]
    low, high = min(a for a, _ in bounds), max(b for _, b in bounds)
    marked = r"(?<![\p{L}\p{N}])(?:" + "|".join(markers([g for _, g in grams], threshold)) + r")(?![\p{L}\p{N}])"
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))

    def bigrams(unit):
        w = F.filter(F.split(unit, r"[^\p{L}\p{N}]+"), lambda x: x != "")
        pairs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1)))
        # bound once: the words are an array of one array
        return F.element_at(F.transform(F.array(w), lambda w: F.when(F.size(w) > low, F.array_distinct(pairs(w)))), 1)

    def scored(b):
        n = F.size(b)
        hits = []
        for (name, g), (lo, hi) in zip(grams, bounds):
            same = F.size(F.array_intersect(b, F.array(*[F.xxhash64(*map(F.lit, x.split(" "))) for x in g])))
            hits.append(F.when(n.between(lo, hi), F.struct((2.0 * same / (n + len(g))).alias("dice"), F.lit(name).alias("name"))))
        return F.array_max(F.filter(F.array(*hits), lambda h: h["dice"] >= threshold))

    def matches(units):
        sets = F.transform(F.filter(units, lambda x: x.rlike(marked)), bigrams)
        return F.filter(F.transform(F.filter(sets, lambda b: F.size(b).between(low, high)), scored), lambda h: h.isNotNull())

    text = F.col("__text")
    larger = F.when(F.instr(text, "\n") > 0, F.array_union(F.split(text, PARAGRAPH), F.array(text))).otherwise(F.array().cast("array<string>"))
    return (
        docs.select(F.col(id_col), F.when(lower.rlike(marked), lower).otherwise("").alias("__text"))
        .select(F.col(id_col), matches(F.split(text, "\n")).alias("__lines"), matches(larger).alias("__larger"))
        .select(
            F.col(id_col),
            F.sort_array(F.array_distinct(F.transform(F.concat("__lines", "__larger"), lambda h: h["name"]))).alias("licenses"),
            # the best: highest Dice, then the first name
            F.array_min(F.transform(F.concat("__lines", "__larger"), lambda h: F.struct((-h["dice"]).alias("d"), h["name"].alias("name")))).alias("__best"),
            F.size("__lines").cast("long").alias("n_matches"),
        )
        .select(id_col, F.col("__best.name").alias("license_id"), (-F.col("__best.d")).alias("dice"), "licenses", "n_matches")
    )
