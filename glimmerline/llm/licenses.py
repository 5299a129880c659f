"""License notices in texts: Dice coefficient of word bigrams against templates; DataFrame functions only.

Units of a text are its lines, its paragraphs, the whole, and runs of words
inside it. A unit can reach the wanted coefficient only if its number of
distinct bigrams lies within bounds given by the template's, and only if it
holds one of a few words: of a template's bigrams it must share so many that
every choice of the others includes one with such a word. Both tests lose
nothing. Runs have at most as many bigrams as the upper bound and begin and end
with a bigram of the template: without such ends a run only scores less.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

#: Short notices as licensors publish them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
    "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
    "in all copies or substantial portions of the Software.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:",
}

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    "Software. "
)
_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole license texts, which reach no short notice by size.
FULL_TEXTS = {
    "mit-full": _GRANT + "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-full": _TWO + _AS_IS,
    "bsd-3-full": _TWO + _THIRD + _AS_IS,
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
    "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
    "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}


def bigrams_of(text: str) -> set[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """Numbers of bigrams from which a coefficient of `least` with a template of `size` can be reached."""
    slack = 1e-9
    return math.ceil(least / (2 - least) * size - slack), math.floor((2 - least) / least * size + slack)


def asked_words(grams: set[str], least: float, known: set[str] = frozenset()) -> set[str]:
    """Few words such that a unit within reach of the template holds one of them; long words are rarer, `known` ones cost nothing."""
    open_, needed = set(grams), math.ceil(least / (2 - least) * len(grams) - 1e-9)
    chosen: set[str] = set()
    while len(open_) >= needed:  # a unit could still share enough without any chosen word
        count: dict[str, int] = defaultdict(int)
        for g in open_:
            for w in set(g.split()):
                count[w] += 1
        word = max(count, key=lambda w: (sum(len(w) >= n for n in (4, 5, 7)), w in known, count[w], len(w), w))
        chosen.add(word)
        open_ = {g for g in open_ if word not in g.split()}
    return chosen


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _units(text: Column) -> Column:
    """Lines, paragraphs and the whole text, each once, with their kind."""
    part = lambda kind, units: F.transform(units, lambda u: F.struct(u.alias("unit"), F.lit(kind).alias("kind")))
    lines, paragraphs = F.split(text, r"\n"), F.split(text, r"\n[ \t\r]*\n")
    several = F.filter(paragraphs, lambda p: p.contains("\n"))
    whole = F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(part("line", F.array_distinct(lines)), part("paragraph", several), part("text", whole))


def _pairs(words: Column) -> Column:
    """Bigrams of a list of words, in order."""
    less = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, less), F.slice(words, 2, less), lambda a, b: F.concat_ws(" ", a, b))


def _runs(row: Column, needed: Column, high: Column, least: float) -> Column:
    """Runs (dice, start, length) inside `row` (all: bigrams in order, g: of the template); of runs that overlap the best is kept."""
    run = "struct<dice:double,start:int,length:int>"
    at = F.filter(F.sequence(F.lit(0), F.size(row["all"]) - 1), lambda i: F.array_contains(row["g"], F.get(row["all"], i)))

    def scored(start: Column, end: Column) -> Column:
        grams = F.array_distinct(F.slice(row["all"], start + 1, end - start + 1))
        dice = 2.0 * F.size(F.array_intersect(grams, row["g"])) / (F.size(grams) + F.size(row["g"]))
        return F.struct(dice.alias("dice"), start.alias("start"), (end - start + 1).alias("length")).cast(run)

    def best_from(places: Column, k: Column) -> Column:
        """The best run from the k-th place; it holds `needed` places at least, so ends before that one are not tried."""
        start = F.get(places, k)
        ends = F.filter(F.slice(places, k + needed, F.greatest(F.least(high, F.size(places) - k - needed + 1), F.lit(0))), lambda e: e - start < high)
        return F.array_max(F.transform(ends, lambda e: scored(start, e)))

    def keep(chosen: Column, one: Column) -> Column:
        last = F.element_at(chosen, -1)
        apart = (F.size(chosen) == 0) | (F.get(chosen, F.size(chosen) - 1)["start"] + F.get(chosen, F.size(chosen) - 1)["length"] <= one["start"])
        better = F.concat(F.slice(chosen, 1, F.greatest(F.size(chosen) - 1, F.lit(0))), F.array(one))
        return F.when(apart, F.concat(chosen, F.array(one))).when(one["dice"] > last["dice"], better).otherwise(chosen)

    def found(places: Column) -> Column:
        starts = F.when(F.size(places) >= needed, F.sequence(F.lit(0), F.size(places) - needed)).otherwise(F.array().cast("array<int>"))
        runs = F.filter(F.transform(starts, lambda k: best_from(places, k)), lambda r: r["dice"] >= least)
        return F.aggregate(runs, F.array().cast(f"array<{run}>"), keep)

    return F.flatten(F.transform(F.array(at), found))  # inside the lambda the places are made once


def _inside(frame: DataFrame, doc_id: str, grams: dict[str, set[str]], least: float) -> DataFrame:
    """Rows (id, license, kind, unit, dice) of runs of words in texts; only texts that share enough bigrams with a template are searched."""
    listed = frame.withColumn("words", _words(F.col("_text"))).withColumn("all", _pairs(F.col("words"))).withColumn("own", F.array_distinct("all"))
    each = []
    for name, g in grams.items():
        needed = max(size_bounds(len(g), least)[0], 1)
        lit = F.array(*[F.lit(x) for x in sorted(g)])
        high = F.lit(size_bounds(len(g), least)[1])
        some = F.struct(F.lit(name).alias("license"), lit.alias("g"), F.lit(needed).alias("needed"), high.alias("high"))
        each.append(F.when(F.size(F.array_intersect("own", lit)) >= needed, some))
    near = listed.withColumn("t", F.explode(F.array_compact(F.array(*each)))).select(doc_id, "words", "all", "t.*")
    runs = _runs(F.struct("all", "g"), F.col("needed"), F.col("high"), least)
    found = near.select(doc_id, "license", "words", F.explode(runs).alias("m"))
    unit = F.array_join(F.slice("words", F.col("m.start") + 1, F.col("m.length") + 1), " ")
    return found.select(doc_id, "license", F.lit("inside").alias("kind"), unit.alias("unit"), "m.dice")


def license_matches(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, templates: dict[str, str] | None = None
) -> DataFrame:
    """Rows (id, license, kind, unit, dice) of units that reach `least` with a template; equal lines of a text count once.

    Kind `inside` are runs of words anywhere in the text, lower-cased; a notice
    that is a line or a paragraph of its own is given as a run too. Of runs of
    one license that overlap, the best is given.
    Null and empty texts have no units. Rows that share an id each give their
    own matches.
    """
    grams = {k: g for k, t in sorted((templates or TEMPLATES | FULL_TEXTS).items()) if (g := bigrams_of(t))}
    asked: set[str] = set()
    for g in grams.values():
        asked |= asked_words(g, least, asked)
    asked = sorted(asked)
    few = "|".join(w for w in asked if len(w) <= 4)  # short words are parts of many others
    short = f"(?<![a-z0-9])(?:{few})(?![a-z0-9])" if few else ""

    def holds(unit: Column) -> Column:
        """Inside the lambda the lower-cased unit is made once, not once per word."""
        tests = lambda low: [low.contains(w) for w in asked if len(w) > 4] + [low.rlike(short)] * bool(short)
        return F.exists(F.array(F.lower(unit)), lambda low: _any(tests(low)))

    frame = docs.select(F.col(doc_id), F.col(text).alias("_text")).filter(holds(F.col("_text")))
    units = frame.select(doc_id, F.explode(_units(F.col("_text"))).alias("u")).select(doc_id, "u.unit", "u.kind")
    units = units.filter(holds(F.col("unit"))).withColumn("words", _words(F.col("unit")))
    pairs = F.array_distinct(_pairs(F.col("words")))
    units = units.withColumn("grams", pairs).withColumn("size", F.size("grams"))
    each = []
    for name, g in grams.items():
        low_, high = size_bounds(len(g), least)
        both = F.size(F.array_intersect("grams", F.array(*[F.lit(x) for x in sorted(g)])))
        dice = F.when(F.col("size").between(low_, high), 2.0 * both / (F.col("size") + len(g)))
        each.append(F.struct(F.lit(name).alias("license"), dice.alias("dice")))
    found = units.select(doc_id, "kind", "unit", F.explode(F.filter(F.array(*each), lambda e: e["dice"] >= least)).alias("m"))
    return found.select(doc_id, "m.license", "kind", "unit", "m.dice").unionByName(_inside(frame, doc_id, grams, least))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """Per document with a notice and license: number of units that match it and the best coefficient.

    Runs inside a text count where no line, paragraph or whole text matches.
    """
    found = license_matches(docs, doc_id, text, least)
    of = lambda kind: F.when(F.col("kind") == "inside" if kind else F.col("kind") != "inside", F.col("dice"))
    both = found.groupBy(doc_id, "license").agg(*[f(of(k)).alias(f"{n}{k:d}") for k in (False, True) for n, f in (("n", F.count), ("best", F.max))])
    count = F.when(F.col("n0") > 0, F.col("n0")).otherwise(F.col("n1"))
    return both.select(doc_id, "license", count.alias("n_units"), F.round(F.coalesce("best0", "best1"), 6).alias("best_dice"))
