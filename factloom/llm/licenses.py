"""Licence scan: word-bigram Dice against templates, with DataFrame functions only.

A text is normalised (lower case, punctuation to spaces) as a whole and line by line; each unit's distinct word
bigrams are compared with those of every template whose size lies within the bounds that the threshold allows:
Dice 2*c/(a+b) >= t with c <= min(a, b) needs b*t/(2-t) <= a <= b*(2-t)/t. One map over whole texts, no shuffle.

Between line and whole text lie windows of words, over line ends too: they start at bigrams of a template where enough
of its bigrams follow (a window that reaches t holds at least b*t/(2-t) of them) and take lengths from the least to the
most that the bounds allow. For templates of over 16 bigrams lengths go in steps of 1/16 of the template, above 32
starts in steps of 1/32 of it after the first; from 256 on both in steps of 1/8. "All rights reserved" counts in a window
only where no licence is found. The SQL has no windows: its Dice is a lower bound.

Null, empty or wordless text: no licence (null), dice 0. Ties: the smaller template name. Repeated rows: one result each.
Very long texts: whole. Empty table: empty result. Extra columns: ignored.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: One-line notices as they stand in files and pages, by SPDX name.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Licence texts without their copyright lines.
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)

#: Whole licences, files of `license_texts`.
WHOLE = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
#: Headers that differ from GPL-3.0's in the licence's name or version.
HEADERS = (("GPL-2.0", "", "2"), ("LGPL-2.1", "Lesser", "2.1"), ("LGPL-3.0", "Lesser", "3"), ("AGPL-3.0", "Affero", "3"))


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, sorted."""
    words = re.sub(r"[^\w]+|_", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def full_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of the whole licences in `license_texts` and of more GNU headers, for windows only."""
    whole = [(name, (pkgutil.get_data("factloom.llm", f"license_texts/{name}.txt") or b"").decode()) for name in WHOLE]
    header = next(t for n, t in TEXTS if n == "GPL-3.0")
    for name, kind, version in HEADERS:
        text = header.replace("General", f"{kind} General").replace("version 3", f"version {version}")
        whole += [(name, text), (name, text.replace("This program", "This library"))][: 2 if kind == "Lesser" else 1]
    return tuple(whole)


def full_templates(threshold: float = THRESHOLD) -> list[tuple[str, int, int, list[str]]]:
    """`templates` of the full texts."""
    return _sized(full_texts(), threshold)


def templates(threshold: float = THRESHOLD) -> list[tuple[str, int, int, list[str]]]:
    """(name, least size, most size, bigrams) of each template."""
    return _sized(NOTICES + TEXTS, threshold)


def _sized(texts: tuple[tuple[str, str], ...], threshold: float) -> list[tuple[str, int, int, list[str]]]:
    out = []
    for name, text in texts:
        grams = bigrams(text)
        n = len(grams)
        out.append((name, math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9), grams))
    return out


def windows(known: list[tuple[str, int, int, list[str]]], texts: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int, int, list[int], list[str]]]:
    """(name, least shared bigrams, most words apart, step of starts, window lengths, bigrams) of each template."""
    out = []
    for (name, lo, hi, grams), (_, text) in zip(known, texts, strict=True):
        n, long = len(grams), max(len(re.sub(r"[^\w]+|_", " ", text.lower()).split()) - 1, 1)
        most = max(hi, hi * long // n)
        out.append((name, lo, most, max(1, n // (32 if n < 256 else 8)), sorted({*range(lo, most + 1, max(1, n // (16 if n < 256 else 8))), long, most}), grams))
    return out


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _better(m: Column, s: Column) -> Column:
    """The greater Dice, then the smaller name."""
    return F.when((s["dice"] > m["dice"]) | ((s["dice"] == m["dice"]) & (s["name"] < m["name"])), s).otherwise(m)


def _window_hit(text: Column, threshold: float) -> Column:
    """Best (dice, name) of the windows of a text; 0 and null if none reaches the threshold."""
    none = F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name"))
    # one literal a template: its bigrams are cut apart when the plan is folded
    known = windows(templates(threshold) + full_templates(threshold), NOTICES + TEXTS + full_texts())
    tables = [F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(need).alias("need"), F.lit(most).alias("most"), F.lit(step).alias("step"), F.split(F.lit(",".join(map(str, lens))), ",").cast("array<int>").alias("lens"), F.split(F.lit("|".join(grams)), r"\|").alias("grams"))
        for name, need, most, step, lens, grams in known if (len(grams) >= 256) == large
    ]) for large in (False, True)]
    vocabulary = sorted({g for *_, grams in known if len(grams) < 256 for g in grams})

    def of_template(t: Column, pairs: Column, hits: Column) -> Column:
        own = F.filter(hits, lambda h: F.array_contains(t["grams"], h["b"]))

        def score(s: Column, n: Column) -> Column:
            return _bind(F.array_distinct(F.slice(pairs, s["i"] + 1, n)), lambda w: F.struct((F.lit(2.0) * F.size(F.array_intersect(w, t["grams"])) / (F.size(w) + F.size(t["grams"]))).alias("dice"), t["name"].alias("name")))

        def scored(own: Column) -> Column:
            dense = F.filter(own, lambda h, k: F.get(own, k + t["need"] - 1)["i"] - h["i"] < t["most"])
            starts = F.filter(dense, lambda h, k: k % t["step"] == 0)
            return F.flatten(F.transform(starts, lambda s: F.transform(t["lens"], lambda n: score(s, n))))

        return _bind(own, scored)

    def of_pairs(pairs: Column) -> Column:
        placed = F.transform(pairs, lambda b, i: F.struct(i.alias("i"), b.alias("b")))
        hits = F.filter(placed, lambda h: h["b"].isin(vocabulary))
        short = _bind(hits, lambda hits: F.flatten(F.transform(F.filter(tables[0], lambda t: F.size(hits) >= t["need"]), lambda t: of_template(t, pairs, hits))))
        # whole licences are looked for only in texts that hold enough of their bigrams
        near = F.filter(tables[1], lambda t: (F.size(pairs) >= t["need"]) & (F.size(F.array_intersect(pairs, t["grams"])) >= t["need"]))
        return F.concat(short, F.flatten(F.transform(near, lambda t: of_template(t, pairs, placed))))

    found = _bind(_words(text), lambda words: _bind(_pairs(words), of_pairs))
    good = F.filter(found, lambda s: s["dice"] >= threshold)

    def best(good: Column) -> Column:
        licence = F.aggregate(F.filter(good, lambda s: s["name"] != "all-rights-reserved"), none, _better)
        return _bind(licence, lambda x: F.when(x["dice"] > 0, x).otherwise(F.aggregate(good, none, _better)))

    return _bind(good, best)


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, n_lines) per row: best template of any unit or window, its Dice, and how many lines match some template."""
    known = templates(threshold)
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*map(F.lit, g)).alias("grams")) for n, lo, hi, g in known])
    least = min(lo for _, lo, _, _ in known)

    def best(grams: Column) -> Column:
        near = F.filter(table, lambda t: (F.size(grams) >= t["lo"]) & (F.size(grams) <= t["hi"]))
        scored = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))).alias("dice"), t["name"].alias("name")))
        good = F.filter(scored, lambda s: s["dice"] >= threshold)
        # greatest Dice, then the smaller name
        return F.aggregate(good, F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name")), lambda m, s: F.when((s["dice"] > m["dice"]) | ((s["dice"] == m["dice"]) & (s["name"] < m["name"])), s).otherwise(m))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    units = F.concat(F.array(text), F.split(text, "\n"))
    # unit 0 is the whole text; words and bigrams are bound once per unit
    sized = F.filter(F.transform(units, lambda u, i: F.struct((i > 0).cast("int").alias("line"), _words(u).alias("words"))), lambda u: F.size(u["words"]) > least)
    gramed = F.transform(sized, lambda u: F.struct(u["line"].alias("line"), _bigrams(u["words"]).alias("grams")))
    found = F.transform(gramed, lambda u: F.struct(u["line"].alias("line"), best(u["grams"]).alias("hit")))
    found = F.filter(found, lambda u: u["hit"]["dice"] > 0)
    top = F.aggregate(
        found,
        F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("lines")),
        lambda m, u: F.struct(
            F.greatest(m["dice"], u["hit"]["dice"]).alias("dice"),
            F.when((u["hit"]["dice"] > m["dice"]) | ((u["hit"]["dice"] == m["dice"]) & (u["hit"]["name"] < m["name"])), u["hit"]["name"]).otherwise(m["name"]).alias("name"),
            (m["lines"] + u["line"]).alias("lines"),
        ),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), top.alias("top"), _window_hit(text, threshold).alias("window"))
    rows = rows.withColumn("hit", _better(F.struct("top.dice", "top.name"), F.col("window")))
    return rows.select("doc_id", F.col("hit.name").alias("license"), F.round("hit.dice", 6).alias("dice"), F.col("top.lines").cast("long").alias("n_lines"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL."""
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rows = ",\n".join(f"({text(n)}, {lo}, {hi}, [{', '.join(map(text, g))}])" for n, lo, hi, g in templates(threshold))
    return rf"""
WITH templates(name, lo, hi, grams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT r, 0 AS pos, text AS unit FROM docs
  UNION ALL SELECT r, 1, unnest(string_split(text, chr(10))) FROM docs),
worded AS (SELECT row_number() OVER () AS u, r, pos, list_filter(string_split(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM units),
gramed AS (SELECT u, r, pos, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM worded WHERE len(words) > 1),
scored AS (
  SELECT u, r, pos, name, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM gramed g JOIN templates t ON len(g.grams) BETWEEN t.lo AND t.hi),
best AS (SELECT r, arg_max(name, (dice, -rank)) AS license, max(dice) AS dice, count(DISTINCT CASE WHEN pos = 1 THEN u END) AS n_lines
         FROM (SELECT *, dense_rank() OVER (ORDER BY name) AS rank FROM scored WHERE dice >= {threshold}) GROUP BY r)
SELECT d.doc_id, b.license, round(coalesce(b.dice, 0.0), 6)::DOUBLE AS dice, CAST(coalesce(b.n_lines, 0) AS BIGINT) AS n_lines
FROM docs d LEFT JOIN best b ON d.r = b.r
"""
