"""Licence scan by a positional index of rare template words, in DataFrame functions only.

One pass counts in how many documents each word of the licence templates
occurs.  A template is indexed by its words of highest IDF, ``RARE`` of them and
all that are as rare as the last: a posting is (word, template, position in the
template, weight).  A file's licence words of highest IDF, all that have
postings, are looked up; each posting gives the place where its template would
start in the file, and the postings that agree on a place are intersected
there, after the template's mandatory phrases have been verified word by word
at their positions.  The score of a template is the IDF weight of its postings
that agree, as a share of all its indexed weight, at the file's best place; from
``LEAST`` on its label holds.  Templates are whole licence texts or notices and
the short forms that people write; a label may have several.

Everything happens inside a row, so nothing but the bounded counts (one row a
template word) is shuffled or sent to the driver, and a text that repeats a
notice many times costs time in proportion.

Defined cases: a null text is empty; texts without words have no places and
score 0; repeated rows each get a row; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: phrase -> label, looked for everywhere
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def plain_words(text: str) -> list[str]:
    """The words of a text, A-Z lower-cased (on the driver)."""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


# Public licence texts and notices (label, text, mandatory phrases).
TEMPLATES = [
    ("mit", "released under the MIT License", ["MIT License"]),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["Permission is hereby granted, free of charge", "The above copyright notice and this permission notice shall be included"],
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["Permission is hereby granted, free of charge"]),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ["Apache License, Version 2.0"]),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ["Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing"],
    ),
    ("gpl-3.0", "licensed under the GNU General Public License version 3", ["General Public License version 3"]),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
        ["GNU General Public License as published by", "either version 3 of the License"],
    ),
    ("gpl-2.0", "licensed under the GNU General Public License version 2", ["General Public License version 2"]),
    (
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation; either version 2 of the License, or (at your option) any later version.""",
        ["GNU General Public License as published by", "either version 2 of the License"],
    ),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ["Lesser General Public License"]),
    ("agpl-3.0", "GNU Affero General Public License version 3", ["Affero General Public License"]),
    (
        "agpl-3.0",
        """you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
        ["Affero General Public License"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary
        form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
        ["Redistribution and use in source and binary forms", "must retain the above copyright notice"],
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ["Redistribution and use in source and binary forms"]),
    ("cc-by-4.0", "licensed under CC BY 4.0", ["CC BY 4.0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["Creative Commons Attribution 4.0"]),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ["CC BY-NC 4.0"]),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ["CC BY-SA 4.0"]),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at https://mozilla.org/MPL/2.0/.""",
        ["Mozilla Public License"],
    ),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ["Mozilla Public License"]),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        ["Permission to use, copy, modify, and/or distribute this software"],
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["Permission to use, copy, modify, and/or distribute this software"]),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ["free and unencumbered software"],
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
        use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions""",
        ["without any express or implied warranty", "alter it and redistribute it freely"],
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""",
        ["any person or organization obtaining a copy", "accompanying documentation covered by this license"],
    ),
]
#: rarest words that a template is indexed by, at least
RARE = 8
#: a template's label needs this share of its indexed weight
LEAST = 0.6


def words_of(text: Column) -> Column:
    """The words; lower() also changes non-ASCII letters, which moves no word's limits
    and can make no word of the base phrases."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def document_counts(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Documents, and documents with each word of the vocabulary: a row a word at most."""
    listed = F.array(*(F.lit(w) for w in vocabulary))
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words_of(F.col(text_col)), listed))).alias("w"))
    counts = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def positional_index(n_docs: int, counts: dict[str, int], templates=TEMPLATES, rare: int = RARE) -> list[dict]:
    """Postings of the words of highest IDF, ties with the last included; their weights add up to 1 in each template."""
    out = []
    for t, (_, text, _) in enumerate(templates):
        own = plain_words(text)
        idf = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in own}
        cut = sorted(idf.values(), reverse=True)[: max(1, rare)][-1]
        places = [(w, q) for q, w in enumerate(own) if idf[w] >= cut]
        total = sum(idf[w] for w, _ in places)
        out += [{"w": w, "t": t, "q": q, "x": idf[w] / total} for w, q in places]
    return out


def phrase_places(templates=TEMPLATES) -> list[list[dict]]:
    """For each template its mandatory phrases and where they stand in it."""
    out = []
    for _, text, phrases in templates:
        own, held = plain_words(text), []
        for p in phrases:
            w = plain_words(p)
            at = next(i for i in range(len(own)) if own[i : i + len(w)] == w)
            held.append({"at": at, "p": w})
        out.append(held)
    return out


def base_places(words: Column, low: Column) -> Column:
    """Sorted struct(at, label) of all places of the base phrases."""

    def here(i: Column, phrase: str) -> Column:
        out = F.lit(True)
        for k, w in enumerate(phrase.split()):
            out &= F.get(words, i + k) == w
        return out

    def maybe(phrase: str) -> Column:
        out = F.lit(True)
        for w in phrase.split():
            out &= low.contains(w)
        return out

    possible = F.lit(False)
    for phrase in BASE:
        possible |= maybe(phrase)
    def label_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, name in BASE.items():
            out = F.when(here(i, phrase), F.lit(name)).otherwise(out)
        return out

    every = F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("at"), label_at(i).alias("label"))), lambda x: x["label"].isNotNull())
    nothing = F.from_json(F.lit("[]"), "array<struct<at:int,label:string>>")
    return F.when(possible & (F.size(words) > 0), every).otherwise(nothing)


def template_scores(words: Column, index: list[dict], templates=TEMPLATES) -> Column:
    """For each template the best share of its weight that agrees on one place."""
    by_word: dict[str, list[dict]] = {}
    for p in index:
        by_word.setdefault(p["w"], []).append({k: p[k] for k in "tqx"})
    postings = literal(by_word, "map<string,array<struct<t:int,q:int,x:double>>>")
    indexed = F.array(*(F.lit(w) for w in sorted({p["w"] for p in index})))
    phrases = literal(phrase_places(templates), "array<array<struct<at:int,p:array<string>>>>")
    none = F.array_repeat(F.lit(0.0), len(templates))

    def hits(i: Column) -> Column:
        own = F.filter(F.try_element_at(postings, F.get(words, i)), lambda p: i >= p["q"])
        return F.transform(own, lambda p: F.struct(p["t"].alias("t"), (i - p["q"]).alias("o"), p["q"].alias("q"), p["x"].alias("x")))

    def verified(h: Column) -> Column:
        return F.forall(F.element_at(phrases, h["t"] + 1), lambda p: F.slice(words, h["o"] + p["at"] + 1, F.size(p["p"])) == p["p"])

    def places(rare: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(rare, F.get(words, i)))

    # the file's indexed words are worked out once, as an element of an array
    at = F.flatten(F.transform(F.filter(F.array(F.array_intersect(words, indexed)), lambda rare: F.size(rare) > 0), places))
    agreeing = F.array_sort(F.filter(F.flatten(F.transform(at, hits)), verified))
    start = F.struct(F.lit(-1).alias("t"), F.lit(-1).alias("o"), F.lit(0.0).alias("s"), none.alias("best"))

    def step(acc: Column, h: Column) -> Column:
        s = F.when((acc["t"] == h["t"]) & (acc["o"] == h["o"]), acc["s"]).otherwise(F.lit(0.0)) + h["x"]
        best = F.transform(acc["best"], lambda v, k: F.when(k == h["t"], F.greatest(v, s)).otherwise(v))
        return F.struct(h["t"].alias("t"), h["o"].alias("o"), s.alias("s"), best.alias("best"))

    best = F.aggregate(agreeing, start, step, lambda acc: acc["best"])
    return F.when(F.size(words) > 0, best).otherwise(none)


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Columns ``keep``, n_words, places (struct at, label), templates' scores, labels and score."""
    vocabulary = sorted({w for _, text, _ in templates for w in plain_words(text)})
    n_docs, counts = document_counts(docs, text_col, vocabulary)
    index = positional_index(n_docs, counts, templates)
    names = F.array(*(F.lit(t[0]) for t in templates))
    rows = docs.select(*keep, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__low"), words_of(F.col(text_col)).alias("__w"))
    rows = rows.select(*keep, F.size("__w").cast("long").alias("n_words"), base_places(F.col("__w"), F.col("__low")).alias("places"), template_scores(F.col("__w"), index, templates).alias("scores"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.filter(F.transform("scores", lambda s, k: F.when(s >= LEAST, F.element_at(names, k + 1))), lambda x: x.isNotNull())
    return rows.select(
        *keep, "n_words", "places", "scores", base.alias("base_labels"),
        F.array_sort(F.array_union(base, own)).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.array_max("scores"), F.when(F.size("places") > 0, 0.5).otherwise(0.0))).alias("score"),
    )


def op5_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    at = F.transform("places", lambda p: p["at"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def brute_force(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """Words, and places of the base phrases, by comparing at every word (for tests)."""
    own = plain_words(text or "")
    return len(own), [(i, label) for i in range(len(own)) for phrase, label in BASE.items() if own[i : i + len(phrase.split())] == phrase.split()]


def brute_scores(texts: list[str | None], templates=TEMPLATES, rare: int = RARE) -> list[list[float]]:
    """Scores of the templates, laying each of them at every place of every text (for tests)."""
    words = [plain_words(t or "") for t in texts]
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in own for own in words) + 1)) + 1e-6
    out = []
    weights = []
    for _, text, _ in templates:
        own = plain_words(text)
        known = {w: idf(w) for w in own}
        cut = sorted(known.values(), reverse=True)[: max(1, rare)][-1]
        held = [known[w] if known[w] >= cut else 0.0 for w in own]
        weights.append([x / sum(held) for x in held])
    for own in words:
        scores = []
        for (_, text, phrases), weight in zip(templates, weights, strict=True):
            wanted, best = plain_words(text), 0.0
            for o in range(len(own)):
                whole = True
                for p in map(plain_words, phrases):
                    at = next(i for i in range(len(wanted)) if wanted[i : i + len(p)] == p)
                    whole &= own[o + at : o + at + len(p)] == p
                if whole:
                    best = max(best, sum(x for q, x in enumerate(weight) if own[o + q : o + q + 1] == wanted[q : q + 1]))
            scores.append(best)
        out.append(scores)
    return out
