"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Units are every line of a document that has a word, and the whole text if it has several such lines.
A unit's bigrams are the distinct pairs of neighbouring words, lower case, ``licence`` spelt
``license``. The Dice coefficient ``2 |A & B| / (|A| + |B|)`` reaches the threshold only if |A| lies
between ``t / (2 - t)`` and ``(2 - t) / t`` times |B|, so a unit meets only templates of its size; units
whose word counts rule out every template are dropped before bigrams are made. A unit's licence is
its best template at or above the threshold; ties go to the earlier template.

Notices inside longer documents, wrapped over lines or behind comment marks, are found by windows:
all runs of bigrams that begin and end with one of the template's (a window that reaches the threshold
still does without other bigrams at its ends) and have as many distinct ones as the size bounds allow.
Counts run along from each beginning: a bigram is new to the window if it was last seen before it. A
beginning gives its best window; of overlapping windows the one that shares more bigrams counts. A
licence found by windows only is one more of ``n_licensed``. Windows are looked at only if the document
has ``t / (2 - t)`` of a template's bigrams, and bigrams are made only of texts that hold one of the words
without which no template can have so many. Bigrams of windows are compared by 64-bit hash.

Everything happens inside the row: no shuffle, no join, nothing that a hot key could slow down.

Defined cases: a null or empty text has no units and no licence; a text without letters or digits
likewise; repeated rows are scanned alike; an empty table gives an empty result; further columns pass
through ``scan``, whose own columns replace ones of their name. Texts are compared whole.
"""

from __future__ import annotations

from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Per cent of agreement from which a unit counts as the template.
THRESHOLD = 85
#: Public licence notices and texts, by SPDX identifier where there is one.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("All-rights-reserved", "All rights reserved."),
]
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = next(body for name, body in TEMPLATES if name == "BSD-2-Clause")
_STORED = Path(__file__).with_name("licence_texts")
#: Full texts, for windows.
TEXTS = [
    ("ISC", next(body for name, body in TEMPLATES if name == "ISC") + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    *[(name, (_STORED / f"{name}.txt").read_text(encoding="utf-8")) for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0")],
]
WORD = r"[\p{L}\p{N}]+"
COLUMNS = ("n_units", "n_licensed", "licenses", "best_permille")


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text.lower().replace("licence", "license"))


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(n: int, threshold: int = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold with a template of n."""
    return -(-threshold * n // (200 - threshold)), (200 - threshold) * n // threshold


def _longs(grams: list[str]) -> Column:
    """The hashes of bigrams as Spark computes them, a literal."""
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return F.expr(f"array({', '.join(f'{h - (h >> 63 << 64)}L' for h in hashes)})")


def needed_words(templates: list[tuple[str, str]], threshold: int = THRESHOLD) -> list[str]:
    """Words of which a text that reaches the threshold with any template has one at least.

    Of each template so many words are taken that without them too few of its bigrams are left: those
    taken before first, then those of five letters or more that are in most of the bigrams left.
    """
    chosen: list[str] = []
    for _, body in templates:
        grams = {tuple(g.split(" ")) for g in _bigrams(body)}
        left = {g for g in grams if not set(g) & set(chosen)}
        while len(left) >= bounds(len(grams), threshold)[0]:
            count: dict[str, int] = {}
            for g in left:
                for w in set(g):
                    count[w] = count.get(w, 0) + 1
            best = max(count, key=lambda w: (len(w) >= 5, count[w], len(w), w))
            chosen.append(best)
            left = {g for g in left if best not in g}
    return chosen


def with_notices(df: DataFrame, words: str, templates: list[tuple[str, str]], threshold: int, out: str) -> DataFrame:
    """df with the windows of its array of words that are a licence: structs of both, permille, p, e (places of bigrams) and i, the template's number."""
    known = [_bigrams(body) for _, body in templates]
    listed = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(bounds(len(g), threshold)[0]).alias("low"), F.lit(bounds(len(g), threshold)[1]).alias("high"), _longs(g).alias("g")) for i, g in enumerate(known)
    ])
    every, least = _longs(sorted({x for g in known for x in g})), min(bounds(len(g), threshold)[0] for g in known)
    may = F.arrays_overlap(words, F.array(*map(F.lit, needed_words(templates, threshold))))
    out_df = df.withColumn("__may", F.when(may, F.col(words)).otherwise(F.array().cast("array<string>")))
    ends = F.greatest(F.size("__may") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("__may", F.lit(1), ends), F.slice("__may", F.lit(2), ends), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))
    out_df = out_df.withColumn("__hashes", pairs).withColumn("__common", F.array_intersect("__hashes", every))
    near = F.filter(listed, lambda t: F.size(F.array_intersect(F.col("__common"), t["g"])) >= t["low"])
    none = F.array().cast("array<struct<i:int,low:int,high:int,g:array<bigint>>>")
    out_df = out_df.withColumn("__near", F.when(F.size("__common") >= least, near).otherwise(none))
    # Where each bigram was seen before, by sorting; only of documents that are near a template. What lambdas
    # use several times is bound as the one element of an array, else it would be computed anew each time.
    placed = F.array_sort(F.transform(F.when(F.size("__near") > 0, F.col("__hashes")), lambda h, i: F.struct(h.alias("h"), (i + 1).alias("q"))))

    def linked(placed: Column) -> Column:
        before = lambda k: F.get(placed, k - 1)
        seen = F.transform(placed, lambda x, k: F.struct(x["q"].alias("q"), F.when((k > 0) & (before(k)["h"] == x["h"]), before(k)["q"]).otherwise(0).alias("seen"), x["h"].alias("h")))
        return F.struct(F.array_sort(seen).alias("grams"), F.size(F.filter(seen, lambda x: x["seen"] > 0)).alias("repeats"))

    out_df = out_df.withColumn("__linked", F.get(F.transform(F.array(placed), linked), F.lit(0)))

    def windows(doc: Column, t: Column) -> Column:
        marked = F.transform(doc["grams"], lambda x: F.struct(x["q"].alias("q"), x["seen"].alias("seen"), F.array_contains(t["g"], x["h"]).alias("own")))
        return F.flatten(F.transform(F.array(marked), lambda m: F.transform(F.filter(m, lambda x: x["own"]), lambda s: window(t, m, s["q"], doc["repeats"]))))

    def window(t: Column, marked: Column, p: Column, repeats: Column) -> Column:
        start = F.struct(F.lit(0).alias("both"), F.lit(0).alias("size"), F.struct(F.lit(0).alias("permille"), F.lit(0).alias("both"), F.lit(0).alias("e")).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            new = (x["seen"] < p).cast("int")
            both, size = acc["both"] + F.when(x["own"], new).otherwise(0), acc["size"] + new
            permille = F.floor(F.lit(2000) * both / (size + F.size(t["g"]))).cast("int")
            # The longest of the best: counts never fall.
            better = x["own"] & (size <= t["high"]) & (permille >= acc["best"]["permille"])
            return F.struct(both.alias("both"), size.alias("size"), F.when(better, F.struct(permille.alias("permille"), both.alias("both"), (x["q"] + 1).alias("e"))).otherwise(acc["best"]).alias("best"))

        # No window has more bigrams than distinct ones and the document's repeats.
        run = F.slice(marked, p, t["high"] + repeats)
        return F.aggregate(run, start, step, lambda acc: F.struct(acc["best"]["both"].alias("both"), acc["best"]["permille"].alias("permille"), p.alias("p"), acc["best"]["e"].alias("e"), t["i"].alias("i")))

    every_window = F.flatten(F.transform(F.array("__linked"), lambda doc: F.flatten(F.transform("__near", lambda t: windows(doc, t)))))
    found = F.filter(every_window, lambda x: x["permille"] >= threshold * 10)
    out_df = out_df.withColumn("__windows", found)
    beaten = lambda x: F.exists("__windows", lambda y: (y["p"] < x["e"]) & (x["p"] < y["e"]) & (F.struct(y["both"], y["permille"]) > F.struct(x["both"], x["permille"])))
    best = F.filter("__windows", lambda x: ~beaten(x))
    return out_df.withColumn(out, F.coalesce(best, F.array().cast(out_df.schema["__windows"].dataType)))


def scan(df: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """df with the number of units and of licensed ones, the licences found and the best agreement."""
    known = [(i, name, _bigrams(body)) for i, (name, body) in enumerate(templates or TEMPLATES)]
    limits = [bounds(len(g), threshold) for _, _, g in known]
    least, most = min(a for a, _ in limits), max(b for _, b in limits)
    # The literal is as large as the list of templates, which is part of the program.
    listed = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(a).alias("low"), F.lit(b).alias("high"), F.array(*map(F.lit, g)).alias("g"))
        for (i, _, g), (a, b) in zip(known, limits, strict=True)
    ])
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike(WORD))
    out = df.drop(*COLUMNS).withColumn("__lines", F.coalesce(lines, F.array().cast("array<string>")))
    words = F.transform("__lines", lambda u: F.regexp_extract_all(F.regexp_replace(F.lower(u), "licence", "license"), F.lit(WORD), F.lit(0)))
    # No word spans lines: the text's words are those of its lines.
    out = out.withColumn("__line_words", words).withColumn("__text_words", F.flatten("__line_words"))
    out = out.withColumn("__units", F.when(F.size("__lines") > 1, F.concat("__line_words", F.array("__text_words"))).otherwise(F.col("__line_words")))
    fit = F.filter("__units", lambda w: (F.size(w) > least) & (F.size(F.array_distinct(w)) - 1 <= most))
    pairs = F.transform(fit, lambda w: F.array_distinct(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))))

    def best(g):
        """Permille times 1000 plus 999 less the template's number; 0 without a candidate."""
        near = F.filter(listed, lambda t: (F.size(g) >= t["low"]) & (F.size(g) <= t["high"]))
        scored = F.transform(near, lambda t: F.floor(F.lit(2000) * F.size(F.array_intersect(g, t["g"])) / (F.size(g) + F.size(t["g"]))).cast("int") * 1000 + 999 - t["i"])
        return F.coalesce(F.array_max(scored), F.lit(0))

    out = out.withColumn("__best", F.transform(pairs, best)).withColumn("__found", F.filter("__best", lambda x: x >= threshold * 10 * 1000))
    names = F.array(*[F.lit(name) for _, name, _ in known])
    noticed = [*(templates or TEMPLATES), *([] if templates else TEXTS)]
    all_names = F.array(*[F.lit(name) for name, _ in noticed])
    out = out.withColumn("__names", F.array_distinct(F.transform("__found", lambda x: F.element_at(names, (1000 - x % 1000).cast("int")))))
    out = with_notices(out, "__text_words", noticed, threshold, "__notices")
    more = F.filter("__notices", lambda x: ~F.array_contains("__names", F.element_at(all_names, x["i"] + 1)))
    out = out.withColumn("__more", more).withColumn("__more_names", F.array_distinct(F.transform("__more", lambda x: F.element_at(all_names, x["i"] + 1))))
    by_window = F.coalesce(F.array_max(F.transform("__more", lambda x: x["permille"])), F.lit(0))
    found = {
        "n_units": F.size("__units").cast("long"),
        "n_licensed": (F.size("__found") + F.size("__more_names")).cast("long"),
        "licenses": F.array_join(F.array_sort(F.concat("__names", "__more_names")), ","),
        "best_permille": F.greatest(F.coalesce(F.floor(F.array_max("__best") / 1000), F.lit(0)), by_window).cast("long"),
    }
    # A generator of one row keeps filters on its columns from being pushed into the arrays below.
    return out.select(*df.drop(*COLUMNS).columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in found.items()]))))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in all documents."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COLUMNS)


def _sql() -> str:
    rows = ", ".join(f"({i}, '{name}', {len(_bigrams(body))}, {bounds(len(_bigrams(body)))[0]}, {bounds(len(_bigrams(body)))[1]})" for i, (name, body) in enumerate(TEMPLATES))
    grams = ", ".join(f"({i}, '{g}')" for i, (_, body) in enumerate(TEMPLATES) for g in _bigrams(body))
    return rf"""
WITH t(i, name, n, low, high) AS (VALUES {rows}), tg(i, g) AS (VALUES {grams}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
a AS (SELECT r, doc_id, CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END AS units FROM d),
u AS (SELECT r, unnest(range(1, len(units) + 1)) AS k, unnest(units) AS unit FROM a),
w AS (SELECT r, k, regexp_extract_all(replace(lower(unit), 'licence', 'license'), '{WORD}') AS w FROM u),
p AS (SELECT r, k, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) > 1),
g AS (SELECT DISTINCT r, k, w[i] || ' ' || w[i + 1] AS g FROM p),
n AS (SELECT r, k, count(*) AS n FROM g GROUP BY r, k),
x AS (SELECT g.r, g.k, tg.i, count(*) AS both FROM g JOIN tg ON g.g = tg.g GROUP BY g.r, g.k, tg.i),
s AS (SELECT n.r, n.k, max((2000 * coalesce(x.both, 0) // (n.n + t.n)) * 1000 + 999 - t.i) AS best
  FROM n JOIN t ON n.n BETWEEN t.low AND t.high LEFT JOIN x ON x.r = n.r AND x.k = n.k AND x.i = t.i GROUP BY n.r, n.k),
f AS (SELECT s.r, max(best) AS best, count(*) FILTER (best >= {THRESHOLD} * 10000) AS n_licensed,
  string_agg(DISTINCT t.name, ',' ORDER BY t.name) FILTER (best >= {THRESHOLD} * 10000) AS licenses
  FROM s JOIN t ON t.i = 999 - best % 1000 GROUP BY s.r)
SELECT a.doc_id, CAST(len(a.units) AS BIGINT) AS n_units, CAST(coalesce(f.n_licensed, 0) AS BIGINT) AS n_licensed, coalesce(f.licenses, '') AS licenses,
  CAST(coalesce(f.best // 1000, 0) AS BIGINT) AS best_permille
FROM a LEFT JOIN f ON a.r = f.r
"""


OP6_SQL = _sql()
