"""Licence scans: the Dice coefficient of word bigrams against licence templates, in DataFrame operations alone.

Each line of a text, and the text as a whole, is normalised and made a set of word bigrams. Two sets can reach a
coefficient t only if the larger is at most (2 - t) / t times the smaller, so only templates of such a size are compared.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence notices and texts in the words of their licences: fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Released under the MIT License, see LICENSE for details.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "BSD-2-Clause": (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    ),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",),
    "CC0-1.0": (
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: The tag that names a licence, for each of them.
TAG = "SPDX-License-Identifier: {}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A bound on sizes gives way by so much, so that rounding shuts out nothing that reaches least.
LEAST, TINY = 0.8, 1e-9
#: Words before the number of a licence's version.
NUMBERED = ("version", "v", "license", "gpl", "lgpl", "agpl", "mpl", "epl", "apache", "by", "nc", "sa", "attribution", "noncommercial", "sharealike", "cc0", "bsd")


def bigrams_of(text: str) -> list[str]:
    """A template's set, sorted."""
    words = re.sub(r"[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


#: Words that any text may have, so that they tell nothing.
COMMON = frozenset("a all an and any are as at available be but by can express following for from has have if implied in include included including is it its made materials may must name names no nor not of on or other part program public see shall should that the their then these this to use used version was which will with within without work you your under".split())


def templates() -> list[tuple[str, list[str]]]:
    return [(name, bigrams_of(t)) for name, texts in TEMPLATES.items() for t in (*texts, TAG.format(name))]


def versions_of(grams: list[str]) -> list[tuple[str, str]]:
    """The bigrams of a template that state its version, each behind its first word and the space. A text that has the word with other numbers alone states another version."""
    pairs = [g.split(" ") for g in grams]
    return [(f"{a} ", f"{a} {b}") for a, b in pairs if b.isdigit() and (a in NUMBERED or a.isdigit())]


def telling_words(known: list[tuple[str, list[str]]], least: float) -> list[str]:
    """Words without which no text reaches a template: what is left of any template without their bigrams is less than the share of it that is needed."""
    chosen: list[str] = []
    for _, grams in known:
        rest = [set(g.split(" ")) for g in grams if not set(g.split(" ")) & set(chosen)]
        while rest and len(rest) * (2 - least) >= len(grams) * least - TINY:
            words = sorted(set().union(*rest))
            words = [w for w in words if w not in COMMON and not w.isdigit()] or words
            chosen.append(max(words, key=lambda w: (sum(w in r for r in rest), len(w))))
            rest = [r for r in rest if chosen[-1] not in r]
    return chosen


def contradicted(grams: Column, t: Column) -> Column:
    """Whether bigrams state another version than a template, and not its own."""
    return F.exists(t["versions"], lambda v: ~F.array_contains(grams, v["gram"]) & F.exists(grams, lambda g: F.startswith(g, v["word"]) & F.rlike(g, F.lit(" [0-9]+$"))))


def words(text: Column) -> Column:
    """Lower case for A-Z, all but a-z and 0-9 a space, cut there."""
    return F.split(F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")


def bigrams(of: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(of) - 1), lambda i: F.concat_ws(" ", F.get(of, i - 1), F.get(of, i)))
    return F.when(F.size(of) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def runs(lines: Column, taken: Column, todo: Column, least: float) -> Column:
    """(dice, name) of templates in todo that a run of two lines or more reaches, blank lines aside: each by its best run, unless a better one of another template overlaps it.

    lines: arrays of words; taken: of the same lines, whether they match on their own, which no run holds. A run begins at a line that has a bigram of the template,
    also with its neighbours: without its first line it would reach no less otherwise.
    """
    kept = F.filter(F.transform(lines, lambda w, i: F.struct(w.alias("w"), F.get(taken, i).alias("taken"))), lambda x: (F.size(x["w"]) > 1) | (F.get(x["w"], 0) != ""))

    def of(rows: Column) -> Column:
        def around(i: Column) -> Column:
            before = F.when(i > 0, F.array(F.element_at(F.get(rows, i - 1)["w"], -1))).otherwise(F.array().cast("array<string>"))
            after = F.when(i + 1 < F.size(rows), F.array(F.get(F.get(rows, i + 1)["w"], 0))).otherwise(F.array().cast("array<string>"))
            return bigrams(F.concat(before, F.get(rows, i)["w"], after))

        def best_run(t: Column) -> Column:
            none = F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("j"))

            def grown(state: Column, row: Column) -> Column:
                new = F.array_union(state["grams"], bigrams(F.concat(state["last"], row["w"])))
                over = state["over"] | row["taken"] | (F.size(new) * least > t["n"] * (2 - least) + TINY)
                now = F.struct((F.lit(2.0) * F.size(F.array_intersect(new, t["grams"])) / (F.size(new) + t["n"])).alias("dice"), (state["at"] + 1).alias("j"))
                best = F.when(over | (state["at"] == 0), state["best"]).when((now["dice"] >= least) & (now["dice"] > state["best"]["dice"]) & ~contradicted(new, t), now).otherwise(state["best"])
                going = F.struct(new.alias("grams"), F.slice(row["w"], -1, 1).alias("last"), over.alias("over"), (state["at"] + 1).alias("at"), best.alias("best"))
                return F.when(state["over"], state).otherwise(going)

            first = F.struct(F.array().cast("array<string>").alias("grams"), F.array().cast("array<string>").alias("last"), F.lit(False).alias("over"), F.lit(0).alias("at"), none.alias("best"))
            starts = F.filter(F.sequence(F.lit(0), F.size(rows) - 2), lambda i: ~F.get(rows, i)["taken"] & F.arrays_overlap(around(i), t["grams"]))
            found = F.transform(starts, lambda i: F.aggregate(F.slice(rows, i + 1, F.size(rows) - i), first, grown, lambda s: F.struct(s["best"]["dice"].alias("dice"), t["name"].alias("name"), i.alias("i"), (i + s["best"]["j"]).alias("j"))))
            return F.array_max(F.filter(found, lambda x: x["dice"] >= least))

        each = F.reverse(F.array_sort(F.filter(F.transform(todo, best_run), lambda x: x.isNotNull())))
        chosen = F.aggregate(each, F.array().cast("array<struct<dice:double,name:string,i:int,j:int>>"), lambda a, x: F.when(F.exists(a, lambda y: (x["i"] < y["j"]) & (y["i"] < x["j"])), a).otherwise(F.concat(a, F.array(x))))
        return F.transform(chosen, lambda x: F.struct(x["dice"].alias("dice"), x["name"].alias("name")))

    none = F.array().cast("array<struct<dice:double,name:string>>")
    return F.get(F.transform(F.array(kept), lambda rows: F.when(F.size(rows) > 1, of(rows)).otherwise(none)), 0)


def scan(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs: doc_id, n_notices (lines that match a template), licences (their names, sorted), best and dice (the name of the largest coefficient, the first by name among equals, and the coefficient; null and 0 if nothing reaches least).

    A template is no match for a text that states another version than it, and not its own. The text as a whole can match too, and runs of lines, so a licence over many lines is found wherever it stands; n_notices counts single lines alone. Null and empty texts match nothing.
    Equal rows give equal rows; no rows, no result; other columns are not read. Nothing is shuffled: the templates are constants of the plan.
    """
    known = templates()
    version = lambda v: F.struct(F.lit(v[0]).alias("word"), F.lit(v[1]).alias("gram"))
    versions = lambda grams: F.array(*map(version, versions_of(grams))).cast("array<struct<word:string,gram:string>>")
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams"), versions(grams).alias("versions")) for name, grams in known])
    telling = telling_words(known, least)
    starts = "|".join(f"{c}(?:{'|'.join(sorted(w[1:] for w in telling if w[0] == c))})" for c in sorted({w[0] for w in telling}))
    tells = F.rlike(text, F.lit(rf"(?i)(?<![A-Za-z0-9])(?:{starts})(?![A-Za-z0-9])"))
    said = F.when(tells, F.col(text)).otherwise("")  # others match nothing
    units = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.concat(F.array(said), F.split(said, "\n")).alias("units"))
    low, high = min(len(g) for _, g in known) * least / (2 - least) - TINY, max(len(g) for _, g in known) * (2 - least) / least + TINY

    def best(grams: Column) -> Column:
        n = F.size(grams)
        fits = F.filter(names, lambda t: (n * (2 - least) >= t["n"] * least - TINY) & (t["n"] * (2 - least) >= n * least - TINY))
        scored = F.transform(fits, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (n + t["n"])).alias("dice"), t["name"].alias("name"), t.alias("t")))
        return F.array_max(F.transform(F.filter(scored, lambda x: (x["dice"] >= least) & ~contradicted(grams, x["t"])), lambda x: F.struct(x["dice"].alias("dice"), x["name"].alias("name"))))

    every = sorted({g for _, grams in known for g in grams})
    none = F.array().cast("array<struct<dice:double,name:string>>")
    cut = units.select("doc_id", F.transform("units", words).alias("words"))
    sets = cut.select("doc_id", "words", F.transform("words", lambda w: F.when((F.size(w) > low) & F.arrays_overlap(w, F.array(*map(F.lit, telling))), bigrams(w))).alias("sets"))
    found = sets.select("doc_id", "words", F.array_intersect(F.coalesce(F.get("sets", 0), F.array().cast("array<string>")), F.array(*map(F.lit, every))).alias("said"), F.transform("sets", lambda s: F.when((F.size(s) >= low) & (F.size(s) <= high), best(s))).alias("found"))
    # A run that matches a template has so many of its bigrams, and so has the text.
    todo = F.filter(names, lambda t: (F.size(F.array_intersect("said", t["grams"])) * (2 - least) >= t["n"] * least - TINY) & ~F.exists("found", lambda x: F.coalesce(x["name"] == t["name"], F.lit(False))))
    some = F.get("found", 0).isNull() & (F.size("words") > 2) & (F.size("said") * (2 - least) >= min(len(g) for _, g in known) * least - TINY)
    found = found.select("doc_id", "words", "found", F.when(some, todo).alias("todo"))
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1)))
    found = found.select("doc_id", "found", F.when(F.size("todo") > 0, runs(rest("words"), F.transform(rest("found"), lambda x: x.isNotNull()), F.col("todo"), least)).otherwise(none).alias("runs"))
    lines = F.filter(F.slice("found", 2, F.greatest(F.size("found") - 1, F.lit(1))), lambda x: x.isNotNull())
    hits = F.concat(F.filter("found", lambda x: x.isNotNull()), "runs")
    top = F.array_max(F.transform(hits, lambda x: x["dice"]))
    name = F.array_min(F.transform(F.filter(hits, lambda x: x["dice"] == top), lambda x: x["name"]))
    return found.select("doc_id", F.size(lines).cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["name"]))), ",").alias("licences"), name.alias("best"), F.coalesce(top, F.lit(0.0)).alias("dice"))


def oracle(least: float = LEAST) -> str:
    """The same in DuckDB's SQL."""
    grams = lambda g: "[" + ", ".join(f"'{x}'" for x in g) + "]"
    versions = lambda g: "[" + ", ".join(f"{{'word': '{w}', 'gram': '{x}'}}" for w, x in versions_of(g)) + "]" + ("" if versions_of(g) else "::STRUCT(word VARCHAR, gram VARCHAR)[]")
    values = ",\n".join(f"('{name}', {len(g)}, {grams(g)}, {versions(g)})" for name, g in templates())
    return rf"""
WITH template(name, n, grams, versions) AS (VALUES {values}),
units AS (
  SELECT doc_id, rowid AS r, unnest(list_concat([coalesce(text, '')], string_split(coalesce(text, ''), chr(10)))) AS unit,
         generate_subscripts(list_concat([coalesce(text, '')], string_split(coalesce(text, ''), chr(10))), 1) AS k
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
cut AS (
  SELECT doc_id, r, k, string_split(trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS w FROM units),
sets AS (
  SELECT doc_id, r, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM cut),
scored AS (
  SELECT r, k, name, g, versions, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + n) AS dice
  FROM sets JOIN template ON len(g) * {2 - least} >= n * {least} - {TINY} AND n * {2 - least} >= len(g) * {least} - {TINY}),
found AS (
  SELECT r, k, max(dice) AS dice, arg_max(name, (dice, name)) AS name FROM scored WHERE dice >= {least}
  AND len(list_filter(versions, lambda v: NOT list_contains(g, v.gram) AND len(list_filter(g, lambda x: starts_with(x, v.word) AND regexp_matches(x, ' [0-9]+$'))) > 0)) = 0 GROUP BY r, k),
best AS (
  SELECT r, count(*) FILTER (k > 1) AS n_notices, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, max(dice) AS dice, min(name) FILTER (dice = top) AS best
  FROM (SELECT *, max(dice) OVER (PARTITION BY r) AS top FROM found) GROUP BY r)
SELECT doc_id, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(licences, '') AS licences, best, coalesce(dice, 0)::DOUBLE AS dice
FROM (SELECT DISTINCT doc_id, r FROM units) LEFT JOIN best USING (r)
"""
