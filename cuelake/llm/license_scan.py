"""Licence scan with a positional rare-token index, in DataFrame functions only.

Licence texts and notices are the templates. Document frequencies of their words over all files
give each word its IDF, ln(1 + (files + 1) / (files with it + 1)), above 0 however common a word
is. Of each template the highest-IDF words are indexed, with their places: as many as hold more
than ``1 - LEAST_SHARE`` of its IDF beside the weightiest of them, so that no file with ``LEAST_SHARE`` of a
template can lack all but one of them, be the licence rare or in every file.

Of each file the words of highest IDF, those that are in the index, are looked up; each says (template, place in the
file minus place in the template). These postings are intersected by relative position: words that were added or left out
move what comes after them, so two different words agree if their offsets are within the template's drift, 3 places and one
for each ten of its words. Sorted by offset, two next to each other that agree mark a place where the template may stand. There it is
verified in place: its mandatory phrase must stand whole, and words with ``LEAST_SHARE`` of its IDF must stand, each
within twice the drift of where the template has it. No limit is set on words looked up, offsets or matches.

Two passes read the texts, one for the frequencies (a row a word of the templates) and one for the
rest; texts aren't shuffled. The work of a file follows its length and the licences in it.

Defined results: a null text is empty; empty texts have no places, empty labels and score 0;
words of equal IDF are indexed in alphabetical order, all places of a word together; repeated rows are scanned alone;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

# Wording of the licences' own texts and notices, as (label, mandatory phrase, texts).
TEMPLATES = [
    ("mit", "mit license", [
        "released under the MIT License",
        "licensed under the MIT License",
        "uses the MIT License",
    ]),
    ("mit", "permission is hereby granted free of charge", [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ]),
    ("isc", "permission to use copy modify", [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ]),
    ("bsd", "source and binary forms", [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. Redistribution and use in
        source and binary forms""",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    ]),
    ("zlib", "this software is provided as is", [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software.""",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    ]),
    ("unlicense", "released into the public domain", [
        "This is free and unencumbered software released into the public domain.",
    ]),
    ("apache-2.0", "apache license", [
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ]),
    ("gpl-notice", "gnu general public license", [
        "this work is licensed under the GNU General Public License, version 3",
        "released under the GNU General Public License",
        "licensed under the GNU General Public License",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ]),
    ("lgpl", "lesser general public license", [
        "licensed under the GNU Lesser General Public License",
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ]),
    ("agpl", "affero general public license", [
        "licensed under the GNU Affero General Public License",
        "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ]),
    ("mpl-2.0", "mozilla public license", [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
        "subject to the terms of the Mozilla Public License, v. 2.0",
    ]),
    ("cc-by-nc", "cc by nc", ["licensed under CC BY-NC 4.0", "this work is licensed under CC BY-NC 4.0"]),
    ("cc-by-sa", "cc by sa", ["licensed under CC BY-SA 4.0", "this work is licensed under CC BY-SA 4.0"]),
    ("cc-by-nd", "cc by nd", ["licensed under CC BY-ND 4.0", "this work is licensed under CC BY-ND 4.0"]),
    ("cc0", "cc0 1 0", ["licensed under CC0 1.0", "dedicated to the public domain under CC0 1.0"]),
]
# Short names that licences go by in SPDX lines.
SPDX = {
    "MIT": "mit", "ISC": "isc", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "Zlib": "zlib", "Unlicense": "unlicense", "Apache-2.0": "apache-2.0",
    "GPL-2.0": "gpl-notice", "GPL-3.0": "gpl-notice", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "MPL-2.0": "mpl-2.0",
    "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-ND-4.0": "cc-by-nd", "CC0-1.0": "cc0",
}
#: (phrase, label) of the base rule.
BASE_PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
LEAST_SHARE = 0.7

_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN_WORD = re.compile(r"[0-9a-z]+")


def template_words() -> list[tuple[str, list[str], list[int]]]:
    """(label, words, places of the mandatory phrase) of every template."""
    out = []
    lines = [f"SPDX-License-Identifier: {name}" for name in SPDX]
    spdx = [(label, " ".join(_PLAIN_WORD.findall(line.lower())), [line]) for label, line in zip(SPDX.values(), lines, strict=True)]
    for label, phrase, texts in TEMPLATES + spdx:
        wanted = phrase.split()
        for text in texts:
            words = _PLAIN_WORD.findall(text.lower())
            start = next(k for k in range(len(words)) if words[k : k + len(wanted)] == wanted)
            out.append((label, words, list(range(start, start + len(wanted)))))
    return out


def drift(words: list[str]) -> int:
    """How far apart the offsets of two words of the template may be."""
    return 3 + len(words) // 10


def rare_words(words: list[str], idf: dict[str, float]) -> set[str]:
    """The highest-IDF words that hold more than ``1 - LEAST_SHARE`` of the template's IDF beside the weightiest of them; all, if none do."""
    weight = {w: idf[w] * words.count(w) for w in set(words)}
    least, out, held = (1 - LEAST_SHARE) * sum(weight.values()) * (1 + 1e-9), set(), 0.0
    for word in sorted(weight, key=lambda w: (-idf[w], w)):
        out.add(word)
        held += weight[word]
        if held - max(weight[w] for w in out) > least:
            break
    return out


def _words(docs: DataFrame, *carry: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*carry, F.array_remove(F.split(text, _NO_WORD), "").alias("__words"))


def _lowered(word: Column, among: list[str]) -> Column:
    """The word with A-Z lowered if it is one of these plain words, else null: lower() also maps other letters to a-z, hence the size."""
    return F.when(F.lower(word).isin(among) & (F.octet_length(word) == F.length(word)), F.lower(word))


def frequencies(docs: DataFrame) -> dict[str, float]:
    """IDF of every word of the templates: at most as many rows as they have words reach the driver."""
    vocabulary = sorted({w for _, words, _ in template_words() for w in words})
    seen = F.array_distinct(F.array_compact(F.transform("__words", lambda w: _lowered(w, vocabulary))))
    counts = dict(_words(docs).select(F.explode(seen).alias("word")).groupBy("word").count().collect())
    files = docs.count()
    return {w: math.log1p((files + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def _is(word: Column, plain: Column | str, size) -> Column:
    return (F.lower(word) == plain) & (F.octet_length(word) == size)


def phrase_places(words: Column, hits: Column, phrase: str) -> Column:
    """Starts of a phrase, found from its longest word."""
    parts = phrase.split()
    anchor = _anchor(phrase)

    def fits(hit: Column) -> Column:
        found = hit["w"] == parts[anchor]
        for k, w in enumerate(parts):
            if k != anchor:
                place = hit["i"] + (k - anchor)
                found = found & (place >= 0) & F.coalesce(_is(F.get(words, place), w, len(w)), F.lit(False))
        return found

    return F.transform(F.filter(hits, fits), lambda h: h["i"] - anchor)


def _anchor(phrase: str) -> int:
    parts = phrase.split()
    return max(range(len(parts)), key=lambda k: (len(parts[k]), -k))


def _constant(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def found_licences(words: Column, hits: Column, idf: dict[str, float]) -> Column:
    """Labels and shares of the templates that stand in the words."""
    templates, index = [], {}
    for number, (label, own, phrase) in enumerate(template_words()):
        entries = [{"word": w, "place": k, "idf": idf[w]} for k, w in enumerate(own)]
        wanted = {"phrase": f" {' '.join(own[k] for k in phrase)} ", "at": phrase[0], "size": len(phrase)}
        templates.append({"label": label, "total": sum(idf[w] for w in own), "drift": drift(own), "entries": entries, **wanted})
        for word in sorted(rare_words(own, idf)):
            index.setdefault(word, []).extend({"t": number, "k": k, "drift": drift(own)} for k, w in enumerate(own) if w == word)
    table = _constant(
        templates, "array<struct<label: string, total: double, drift: int, entries: array<struct<word: string, place: int, idf: double>>, phrase: string, at: int, size: int>>"
    )
    postings = _constant(index, "map<string, array<struct<t: int, k: int, drift: int>>>")
    none = F.array().cast("array<struct<t: int, k: int, drift: int>>")

    def offsets(hit: Column) -> Column:
        place = lambda p: F.struct(p["t"].alias("t"), (hit["i"] - p["k"]).alias("offset"), hit["w"].alias("w"), p["drift"].alias("drift"))
        return F.transform(F.coalesce(F.try_element_at(postings, hit["w"]), none), place)

    def agreed(placed: Column) -> Column:
        """Templates with the middles of stretches of one drift in which two different words agree."""

        def agrees(p: Column, j: Column) -> Column:
            after = F.get(placed, j + 1)
            return (after["t"] == p["t"]) & (after["w"] != p["w"]) & (after["offset"] - p["offset"] <= p["drift"])

        middle = lambda p: (F.floor(p["offset"] / p["drift"]) * p["drift"] + F.floor(p["drift"] / 2)).cast("int")
        return F.array_distinct(F.transform(F.filter(placed, agrees), lambda p: F.struct(p["t"].alias("t"), middle(p).alias("offset"))))

    def held(place: Column) -> Column:
        return bind(F.struct(F.get(table, place["t"]).alias("t"), place["offset"].alias("offset")), weighed)

    def weighed(x: Column) -> Column:
        t, offset, far = x["t"], x["offset"], 2 * x["t"]["drift"]
        base = F.greatest(F.lit(0), offset - far)
        plain = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise("")
        around = F.transform(F.slice(words, base + 1, F.greatest(F.lit(0), offset + F.size(t["entries"]) + far - base)), plain)

        def judged(around: Column) -> Column:
            def near(first: Column, last: Column) -> Column:
                """Words whose places in the file are first to last."""
                begin = F.greatest(base, first)
                return F.slice(around, begin - base + 1, F.greatest(F.lit(0), last - begin + 1))

            def stands(entry: Column) -> Column:
                place = offset + entry["place"]
                return F.array_contains(near(place - far, place + far), entry["word"])

            start = offset + t["at"]
            said = F.concat(F.lit(" "), F.array_join(near(start - far, start + t["size"] - 1 + far), " "), F.lit(" "))
            share = F.aggregate(F.filter(t["entries"], stands), F.lit(0.0), lambda a, e: a + e["idf"]) / t["total"]
            whole = F.when(F.contains(said, t["phrase"]), F.least(F.lit(1.0), share)).otherwise(0.0)
            return F.struct(t["label"].alias("label"), whole.alias("share"))

        return bind(around, judged)

    looked_up = F.array_sort(F.flatten(F.transform(hits, offsets)))
    shares = F.transform(bind(looked_up, agreed), held)
    return F.filter(shares, lambda s: s["share"] >= LEAST_SHARE - 1e-9)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    idf = frequencies(docs)
    sought = sorted(
        {w for _, own, _ in template_words() for w in rare_words(own, idf)} | {p.split()[_anchor(p)] for p, _ in BASE_PHRASES}
    )
    base = range(len(BASE_PHRASES))
    hit = lambda w, i: bind(_lowered(w, sought), lambda low: F.when(low.isNotNull(), F.struct(low.alias("w"), i.alias("i"))))
    placed = _words(docs, "doc_id").withColumn("__hits", F.array_compact(F.transform("__words", hit)))
    words, hits = F.col("__words"), F.col("__hits")
    found = placed.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        *(F.when(F.size(hits) > 0, phrase_places(words, hits, p)).otherwise(F.array().cast("array<int>")).alias(f"__phrase{k}") for k, (p, _) in enumerate(BASE_PHRASES)),
        F.when(F.size(hits) > 0, found_licences(words, hits, idf)).alias("__found"),
    )
    places = F.concat(*(F.col(f"__phrase{k}") for k in base))
    named = F.array_compact(F.array(*(F.when(F.size(f"__phrase{k}") > 0, F.lit(BASE_PHRASES[k][1])) for k in base)))
    more = F.coalesce(F.transform("__found", lambda x: x["label"]), F.array().cast("array<string>"))
    share = F.coalesce(F.array_max(F.transform("__found", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(named), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(named, more)), ",").alias("labels"),
        F.greatest(share, F.when(F.size(named) > 0, 1.0).otherwise(0.0)).alias("score"),
    )
