"""Licence scans by diagonal voting.

Every run of two words of a text is hashed and joined with the places where the templates have it. A
match votes for the diagonal (place in the text minus place in the template). Votes are summed by
diagonal, neighbouring diagonals are merged (words put in or left out shift the diagonal), and a merged
span is a candidate if it covers enough of its template. A candidate's matches are then aligned with the
template: chains of matches that rise in both, in a span of the text that is not much longer than the
template, with all words that tell the template's licence from its relatives and none of the words that
make it another one. Templates may have any length; beside notices there are the whole short licences.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import Words, separators, text_batches

WORD_BREAKS = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

# The phrases that decide by themselves, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wordings of public licence notices, with the labels they give.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
    "released-mit": "Released under the MIT License",
    "licensed-apache": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "lgpl": "GNU Lesser General Public License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "apache-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "mpl-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Labels of notices that are further wordings of a licence.
SAME = {"released-mit": "mit", "licensed-apache": "apache", "gpl-3": "gpl", "cc-by-sa-short": "cc-by-sa", "cc-by-nc-long": "cc-by-nc", "mit-text": "mit", "bsd-text": "bsd", "isc-text": "isc", "apache-text": "apache", "gpl-text": "gpl", "mpl-text": "mpl", "unlicense-text": "unlicense"}

# Words that tell licences apart, with what they stand for. A template's own must occur in a text's span.
TELLING = {
    "apache": "apache", "mit": "mit", "mozilla": "mozilla", "mpl": "mozilla", "unencumbered": "unencumbered", "gnu": "gnu", "general": "general", "lesser": "lesser", "affero": "affero",
    "cc": "cc", "creative": "cc", "sa": "sa", "sharealike": "sa", "alike": "sa", "nc": "nc", "noncommercial": "nc", "commercial": "nc", "nd": "nd", "noderivatives": "nd", "noderivs": "nd", "derivatives": "nd",
}
# What makes a licence of a family another one, inside a span or, for the first family, right behind it.
OTHER = {"cc": {"sa", "nc", "nd"}, "gnu": {"lesser", "affero"}}

K = 2
GRAMS = "row long, doc_id long, at long, gram long"
#: The gram of the row that carries a document's number of words.
SIZE_GRAM = -1
MEANINGS = sorted(set(TELLING.values()))


def telling_rows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(place, gram) of the telling words; grams from -2 downwards stand for their meanings."""
    known = Words([" ".join(TELLING).encode()], WORD_BREAKS).hashes
    grams = np.array([-2 - MEANINGS.index(m) for m in TELLING.values()], np.int64)
    order = np.argsort(known)
    at = np.flatnonzero(np.isin(words.hashes, known))
    return at, grams[order][np.searchsorted(known[order], words.hashes[at])]


def chains(hits: list[tuple[int, int]], drift: int):
    """Chains of (place in the text, place in the template) that rise in both, from one to the next at most `drift` diagonals apart; the longest first, without common hits."""
    hits = sorted(set(hits))
    at_place: dict[int, list[int]] = {}
    best, before = [1] * len(hits), [-1] * len(hits)
    for i, (at, place) in enumerate(hits):
        for a in range(at - 1, at - place - drift - 1, -1):
            for j in at_place.get(a, ()):
                step = place - hits[j][1]
                if step > 0 and abs(at - a - step) <= drift and best[j] >= best[i]:
                    best[i], before[i] = best[j] + 1, j
        at_place.setdefault(at, []).append(i)
    used: set[int] = set()
    for i in sorted(range(len(hits)), key=lambda i: (-best[i], i)):
        chain = []
        while i >= 0 and i not in used:
            chain.append(i)
            i = before[i]
        if i < 0:
            used.update(chain)
            yield [hits[j] for j in reversed(chain)]


def told_apart(need: set[str], first: int, end: int, telling: list[tuple[int, str]], *, whole: bool, phrase: bool = False) -> bool:
    """Whether the words from first to before end have what the template needs and nothing of its relatives.

    The word behind belongs to them too, unless the `whole` notice ends there and another sentence may begin.
    """
    inside = {m for at, m in telling if first <= at < end}
    behind = {m for at, m in telling if at == end} & OTHER["cc"] if "cc" in need and not whole else set()
    others = set().union(*(OTHER[m] for m in need if m in OTHER))
    return (phrase or need <= inside | behind) and not (inside | behind) & others - need


def needs(wording: str) -> set[str]:
    split = Words([wording.encode()], WORD_BREAKS)
    at, grams = telling_rows(split)
    return {MEANINGS[-2 - g] for g in grams.tolist()}


def template_table(spark, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """gram, template, place, of (its number of grams), base, label; as large as the given wordings, which bound it."""
    rows = []
    for k, (words, label, base) in enumerate([(w, label, True) for w, label in phrases.items()] + [(w, label, False) for label, w in notices.items()]):
        at, grams = Words([words.encode()], WORD_BREAKS).grams(K)
        rows += [(int(g), k, int(i), len(grams), base, label) for i, g in zip(at.tolist(), grams.view("int64").tolist(), strict=True)]
    rows.append((SIZE_GRAM, -1, 0, 1, False, ""))
    rows += [(-2 - k, -2 - k, 0, 1, False, m) for k, m in enumerate(MEANINGS)]
    return spark.createDataFrame(rows, "gram long, template int, place int, of int, base boolean, label string")


def gram_rows(docs: DataFrame) -> DataFrame:
    """A row for every run of two words and every telling word, and one with the number of words for every document."""

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("gram", pa.int64())])
        for batch in batches:
            names, ids = batch.column(0).to_numpy(), batch.column(1)
            for a, b, texts in text_batches(batch.column(2), 1 << 20):
                words = Words(texts, WORD_BREAKS)
                at, grams = words.grams(K)
                told, meaning = telling_rows(words)
                at = np.concatenate([at, told])
                doc = np.concatenate([words.doc[at], np.arange(b - a)])
                place = np.concatenate([at - words.first[words.doc[at]], words.counts])
                value = np.concatenate([grams.view(np.int64), meaning, np.full(b - a, SIZE_GRAM, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(names[a:b][doc]), ids.slice(a, b - a).take(pa.array(doc)), pa.array(place), pa.array(value)], schema=kind)

    named = common.texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return named.mapInArrow(common.lean(run), GRAMS)


def scan(docs: DataFrame, *, cover: float = 0.6, drift: int = 3) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    A phrase counts where its words stand consecutively: all its grams on one diagonal. It gives its base
    label everywhere, and its label unless a word right behind makes it another licence ("CC BY-SA"). A
    notice is a candidate if diagonals at most `drift` apart cover at least `cover` of its grams, and counts
    if a chain of its matches still does, in a span of at most 1 / `cover` times its length, and is told apart from other licences. score is the largest share
    of a template that a document covers, verified from `cover` on, 1 with a phrase. Null and empty texts
    have no words, empty labels and the score 0; repeated rows give repeated results; an empty table gives
    no rows.

    The template table is broadcast: it is as large as the wordings above, whatever the input.
    """
    templates = F.broadcast(template_table(docs.sparkSession))
    known = [(w, label, True) for w, label in PHRASES.items()] + [(w, SAME.get(label, label), False) for label, w in NOTICES.items()]
    wordings = [(label, base, needs(w), len(Words([w.encode()], WORD_BREAKS).hashes)) for w, label, base in known]

    @F.udf("labels array<string>, share double")
    def verify(candidates, telling):
        labels, most = set(), 0.0
        told = [(h["at"], MEANINGS[-2 - t["template"]]) for t in telling or () for h in t["hits"]]
        for c in candidates or ():
            label, base, need, size = wordings[c["template"]]
            hits = [(h["at"], h["place"]) for h in c["hits"]]
            if base:
                full = [d for d, n in Counter(at - place for at, place in hits).items() if n == size - K + 1]
                if any(told_apart(need, d, d + size, told, whole=False, phrase=True) for d in full):
                    labels.add(label)
                continue
            for chain in chains(hits, drift):
                share = len(chain) / (size - K + 1)
                if share < cover:
                    break
                span = chain[-1][0] - chain[0][0] + K
                if span * cover <= size and told_apart(need, chain[0][0], chain[-1][0] + K, told, whole=chain[-1][1] == size - K):
                    labels.add(label)
                    most = max(most, share)
                    break
        return sorted(labels), most

    votes = gram_rows(docs).join(templates, "gram").groupBy("row", "doc_id", "template", "of", "base", "label", (F.col("at") - F.col("place")).alias("diagonal"))
    votes = votes.agg(F.count("*").alias("votes"), F.collect_list(F.struct("at", "place")).alias("hits"))
    by_template = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_template) > drift
    merged = votes.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(by_template))
    spans = merged.groupBy("row", "doc_id", "template", "of", "base", "label", "span").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.min("diagonal").alias("low"),
        F.sum(F.when(F.col("votes") == F.col("of"), 1).otherwise(0)).alias("places_full"),
        F.min(F.when(F.col("votes") == F.col("of"), F.col("diagonal"))).alias("first_full"),
        F.max(F.when(F.col("votes") == F.col("of"), F.col("diagonal"))).alias("last_full"),
    ).withColumn("share", F.size(F.array_distinct("hits.place")) / F.col("of"))
    is_base, is_notice = F.col("base") & (F.col("places_full") > 0), (~F.col("base")) & (F.col("template") >= 0)
    candidate = is_base | (is_notice & (F.col("share") >= cover))
    named = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    result = spans.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") == -1, F.col("low"))).alias("n_words"),
        F.sum(F.when(is_base, F.col("places_full")).otherwise(0)).alias("n_base"),
        F.min(F.when(is_base, F.col("first_full"))).alias("first_word"),
        F.max(F.when(is_base, F.col("last_full"))).alias("last_word"),
        named(F.when(is_base, F.col("label"))).alias("base_labels"),
        F.max(F.when(is_base, 1.0).when(is_notice & ~candidate, F.col("share")).otherwise(0.0)).alias("least"),
        F.collect_list(F.when(candidate, F.struct("template", "hits"))).alias("candidates"),
        F.collect_list(F.when(F.col("template") < -1, F.struct("template", "hits"))).alias("telling"),
    )
    found = result.withColumn("found", verify("candidates", "telling"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join("found.labels", ",").alias("labels"), F.greatest("least", "found.share").alias("score"))
