"""Licence scan with a positional rare-token index, all of it column expressions.

The templates' words get their document frequencies from the whole corpus. The index holds, for the
highest-IDF words of each template, their postings (template, position). Of each file, the places of
all indexed words are looked up; a word at place i with a posting (t, p) stands at the relative
position i - p of template t. Postings intersect where relative positions agree up to SLACK words, so
words that were inserted or left out don't break an alignment: coverage is the IDF share of a
template's indexed words that meet in one such window. A label needs coverage and its mandatory key
phrases word for word. Key phrases are found from their own rarest word, so none is missed.

The work is linear in the indexed words of a file. Nothing is shuffled but word counts (one row for
each template word); a file never leaves its task.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Key phrases with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, wording of a public licence or of the notice that refers to it, mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["permission is hereby granted free of charge", "without warranty of any kind"],
    ),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free of charge", "any person obtaining a copy"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
        or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ["apache license", "unless required by applicable law"],
    ),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along
        with this program.""",
        ["general public license", "free software foundation", "without any warranty"],
    ),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
        "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ["source and binary forms", "conditions are met", "possibility of such damage"],
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "conditions are met"]),
    (
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ["mozilla public license"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
        ["with or without fee", "is hereby granted"],
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee", "hereby granted"]),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        ["must not be misrepresented", "altered source versions"],
    ),
    (
        "boost",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
        ["person or organization obtaining a copy", "prepare derivative works"],
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
        the software to the public domain.""",
        ["unencumbered software", "public domain"],
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]

#: What stands between words. A-Z belong to words; they are compared in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _low(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def _among(word: Column, words: list[str]) -> Column:
    return F.lower(word).isin(words) & _low(word).isin(words)  # the first is quick, the second exact


def _places(words: list[str]) -> Column:
    """Indices into _w of the words given."""
    return F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: _among(F.get("_w", i), words))


def document_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Rows of ``docs``, and for each word how many hold it. The driver gets one count for each word."""
    split = docs.select(F.split(text_or_empty(text_col), BETWEEN).alias("_w"))
    held = split.select(F.array_distinct(F.transform(_places(words), lambda i: _low(F.get("_w", i)))).alias("held"))
    # the empty word counts rows
    counts = held.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r.word: r.n for r in counts.collect()}
    return found.pop("", 0), found


def _starts(phrase: list[str], df: dict[str, int]) -> Column:
    """Where a phrase begins in _w: from the places of its rarest word, in _hits."""
    anchor = min(range(len(phrase)), key=lambda k: (df.get(phrase[k], 0), k))
    begins = F.transform(F.filter("_hits", lambda i: _low(F.get("_w", i)) == phrase[anchor]), lambda i: i - anchor)

    def whole(s: Column) -> Column:
        same = s >= 0
        for k, word in enumerate(phrase):
            same = same & (_low(F.get("_w", s + k)) == word)
        return same

    return F.filter(begins, whole)


#: Words by which parts of one notice may have moved against each other.
SLACK = 16


def wording(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.lower()) if w]


def index_of(rows: int, df: dict[str, int], rare_words: int, rare_share: float) -> list[list[tuple[str, int, float]]]:
    """For each template its indexed words: (word, first place, share). The highest-IDF words, up to rare_words or rare_share of the IDF of all."""
    out = []
    for _, text, _ in TEMPLATES:
        words = wording(text)
        idf = {w: math.log((rows + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in words}
        kept, mass = [], 0.0
        for w in sorted(idf, key=lambda w: (-idf[w], words.index(w))):
            if len(kept) == rare_words or mass >= rare_share * sum(idf.values()):
                break
            kept.append(w)
            mass += idf[w]
        out.append([(w, words.index(w), idf[w] / mass) for w in kept])
    return out


def template_phrases() -> list[list[str]]:
    """The base phrases, then each template's key phrases, as words."""
    return [p.split() for p in BASE_PHRASES] + [p.split() for _, _, keys in TEMPLATES for p in keys]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rare_words: int = 24, rare_share: float = 0.8, min_coverage: float = 0.6) -> DataFrame:
    """One row for each row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the base phrases; first_word and last_word are the smallest and
    largest start among them, in words from 0. labels adds the templates with coverage of min_coverage
    or more and all key phrases. score is the best coverage among the labels, 0 without one. Null
    texts count as empty: no words, no labels ('' in both), null places. An empty table gives an empty
    result, repeated rows and ids are rows of their own; other columns are not read, whatever their names.
    """
    phrases, many = template_phrases(), len(TEMPLATES)
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in wording(text)} | {w for p in phrases for w in p})
    rows, df = document_frequencies(docs, vocabulary, text_col)
    rare = index_of(rows, df, rare_words, rare_share)
    postings: dict[str, list[tuple[int, int, int]]] = {}
    for t, kept in enumerate(rare):
        for k, (w, p, _) in enumerate(kept):
            postings.setdefault(w, []).append((t, k, p))
    anchors = {min(p, key=lambda w: (df.get(w, 0), p.index(w))) for p in phrases}
    indexed = sorted(set(postings) | anchors)

    split = docs.select(F.col(id_col).alias("_id"), F.split(text_or_empty(text_col), BETWEEN).alias("_w")).withColumn("_hits", _places(indexed))
    lead = F.when(F.get("_w", F.lit(0)) == "", 1).otherwise(0)
    trail = F.when((F.size("_w") > 1) & (F.element_at("_w", -1) == ""), 1).otherwise(0)
    found = split.withColumns({f"_p{k}": _starts(p, df) for k, p in enumerate(phrases)}).withColumns({"_lead": lead, "n_words": (F.size("_w") - lead - trail).cast("long")})
    found = found.withColumn("_base", F.concat(*[F.col(f"_p{k}") for k in range(len(BASE_PHRASES))]))

    # a meeting is one long: template, window, word. Windows of 2 SLACK words begin every SLACK words, so whatever lies within SLACK shares one
    order = {w: k for k, w in enumerate(sorted(postings))}
    rank_of = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    before = max(len(wording(text)) for _, text, _ in TEMPLATES) + SLACK
    slots = F.array(*[F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(k).cast("long").alias("k"), F.lit(before - p).alias("d")) for t, k, p in postings[w]]) for w in order])
    span = 1 << 32

    def meetings(i: Column) -> Column:
        of = F.get(slots, F.try_element_at(rank_of, _low(F.get("_w", i))))
        code = lambda x, back: (x["t"] * span + F.floor((i + x["d"]) / SLACK).cast("long") - back) * rare_words + x["k"]
        return F.flatten(F.transform(of, lambda x: F.array(code(x, 0), code(x, 1))))

    met = F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform("_hits", meetings), lambda x: x.isNotNull()))))
    # only a file whose key phrases stand there can get a label
    k, verified = len(BASE_PHRASES), []
    for _, _, keys in TEMPLATES:
        verified.append(F.lit(True))
        for _ in keys:
            verified[-1] = verified[-1] & (F.size(f"_p{k}") > 0)
            k += 1
    bases = [[j for j, base in enumerate(BASE_PHRASES.values()) if base == label] for label, _, _ in TEMPLATES]
    based = [F.size(f"_p{j[0]}") > 0 if j else F.lit(False) for j in bases]
    anything = F.lit(False)
    for v, b in zip(verified, based):
        anything = anything | v | b
    shares = F.array(*[F.lit(float(kept[k][2]) if k < len(kept) else 0.0) for kept in rare for k in range(rare_words)])
    found = found.withColumn("_met", F.when(anything, met).otherwise(F.array().cast("array<long>")))

    def best_of(t: int) -> Column:
        """The heaviest window, in one pass over the template's meetings, which lie together by window."""
        zero = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

        def add(state: Column, x: Column) -> Column:
            window, share = F.floor(x / rare_words).cast("long"), F.get(shares, (x % rare_words).cast("int") + t * rare_words)
            total = F.when(state["at"] == window, state["sum"]).otherwise(F.lit(0.0)) + share
            return F.struct(window.alias("at"), total.alias("sum"), F.greatest(state["best"], total).alias("best"))

        own = F.filter("_met", lambda x: (x >= t * span * rare_words) & (x < (t + 1) * span * rare_words))
        return F.aggregate(own, zero, add, lambda s: s["best"])

    # templates with a posting of their own before window 0 don't occur: ``before`` keeps positions positive
    scored = found.withColumns({f"_c{t}": F.when(verified[t] | based[t], best_of(t)).otherwise(F.lit(0.0)) for t in range(many)})
    label_columns = [F.when(verified[t] & (F.col(f"_c{t}") >= min_coverage), F.lit(label)) for t, (label, _, _) in enumerate(TEMPLATES)]
    counted = [F.when((verified[t] & (F.col(f"_c{t}") >= min_coverage)) | based[t], F.col(f"_c{t}")).otherwise(F.lit(0.0)) for t in range(many)]
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{j}") > 0, F.lit(label)) for j, label in enumerate(BASE_PHRASES.values())]))
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return scored.select(
        F.col("_id").alias(id_col), "n_words", F.size("_base").cast("long").alias("n_base"), (F.array_min("_base") - F.col("_lead")).cast("long").alias("first_word"), (F.array_max("_base") - F.col("_lead")).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, F.array_compact(F.array(*label_columns)))).alias("labels"), F.round(F.least(F.lit(1.0), F.greatest(*counted)), 6).alias("score"),
    )
