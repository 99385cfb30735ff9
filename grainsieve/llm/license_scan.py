"""License notices by MinHash bands over overlapping text windows, with DataFrame functions only.

Templates are grouped into classes by their number of shingles.  A text is read in windows of twice a
class's size that overlap by half, so every occurrence of a template of the class lies in a window.  A
window and a template that agree in one MinHash value meet; the window's exact containment of the
template's shingles decides.

With at least 80 % of a template in a window of twice its class size, the Jaccard similarity is 0.2 or
more, so 40 bands of one row meet with a probability of 1 - 0.8^40 > 0.9998.

A template with fewer words than a shingle is one shingle of all its words; texts are read in shingles
of that many words for it, and only the whole template matches.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainsieve.llm.tables import field, text_or_empty

# Wordings of public licenses' notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT license.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "apache-2.0-disclaimer": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation"),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"),
    "isc-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "mpl-2.0-notice": "Licensed under the Mozilla Public License 2.0.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "lgpl-notice": "This work is licensed under the GNU Lesser General Public License.",
    "lgpl-header": "under the terms of the GNU Lesser General Public License",
    "agpl-notice": "This work is licensed under the GNU Affero General Public License.",
    "agpl-header": "under the terms of the GNU Affero General Public License",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc0-1.0-notice": "Licensed under CC0 1.0 Universal.",
    "bsd-notice": "Released under the BSD License.",
    "bsd-notice-2": "Licensed under the BSD license.",
    "bsd-2-clause-notice": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-notice": "Licensed under the BSD 3-Clause License.",
    "bsd-style-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "bsd-3-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name "
        "of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
        "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
}
#: Templates of fewer words than a shingle.
SHORT_TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
}
#: Words that tell license text; each template must hold enough of them (checked).
GUARDS = ("license", "licensed", "licenses", "permission", "redistribution", "redistribute", "warranties", "sublicense", "copyright", "software", "cc")
WORDS = 5
PERCENT = 80
BANDS = 40


def _template_shingles(text: str, words: int) -> list[str]:
    found = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(" ".join(found[i : i + words]) for i in range(len(found) - words + 1)))


def size_class(n: int) -> int:
    """The smallest power of two that is at least n."""
    return 1 << max(0, (n - 1).bit_length())


def guard_words(templates: dict[str, str], words: int, percent: int, preferred: tuple[str, ...] = GUARDS) -> list[str]:
    """Words of which every window that matches a template holds one.

    More than 100 - percent of each template's shingles hold a guard, so no match can avoid them all;
    where the preferred words are too few, the template's longest words join.
    """
    guards = set(preferred)
    for name, text in templates.items():
        shingles = _template_shingles(text, words)
        if not shingles:
            raise ValueError(f"template {name} has fewer than {words} words")
        more = sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w))
        while 100 * sum(bool(guards & set(s.split())) for s in shingles) <= (100 - percent) * len(shingles):
            guards.add(more.pop(0))
    return sorted(guards)


def _shingles(words: Column, n: int) -> Column:
    """Hashes of all n-word shingles in order; none for fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))).otherwise(
        F.array().cast("array<bigint>"))


def _signature(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda band: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, band))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                 words: int = WORDS, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """Templates that whole texts hold: ``doc_id, license, containment, first_word``.

    Words are ``[a-z0-9]+`` of the lower-cased text.  ``containment`` is the largest share of the
    template's distinct shingles found in one window, ``percent`` / 100 or more; ``first_word`` (from 0)
    is where the first of them stands in the earliest window that reaches it.  One row per id and
    template: rows that repeat an id are reported together, those without an id too.  A null or empty
    text holds none, one with fewer words than a shingle only templates that are as short; an empty
    table gives no rows.
    """
    templates = TEMPLATES | SHORT_TEMPLATES if templates is None else templates
    by_words: dict[int, dict[str, str]] = {}
    for name, text in templates.items():
        by_words.setdefault(min(words, len(re.findall("[a-z0-9]+", text.lower()))), {})[name] = text
    if 0 in by_words:
        raise ValueError(f"template {next(iter(by_words[0]))} has no words")
    found = [_scan(docs, id_col, text_col, own, n, percent, bands, GUARDS if n == words else ()) for n, own in sorted(by_words.items(), reverse=True)]
    return reduce(DataFrame.unionByName, found)


def _scan(docs: DataFrame, id_col: str, text_col: str, templates: dict[str, str], words: int, percent: int, bands: int,
          preferred: tuple[str, ...]) -> DataFrame:
    """The scan for templates that have at least ``words`` words each."""
    spark = docs.sparkSession
    guards = guard_words(templates, words, percent, preferred)
    rows = [(name, size_class(len(s)), s) for name, text in templates.items() for s in [_template_shingles(text, words)]]
    values = [F.struct(F.lit(name).alias("license"), F.lit(size).alias("class"), F.array(*map(F.lit, own)).alias("texts")) for name, size, own in rows]
    table = spark.range(1).select(F.inline(F.array(*values)))
    table = table.withColumn("own", F.transform("texts", lambda s: F.xxhash64(s))).drop("texts")
    banded = table.select("license", "class", "own", F.posexplode(_signature(F.col("own"), bands)).alias("band", "value"))
    classes = sorted({row[1] for row in rows})

    lower = F.lower(text_or_empty(text_col))
    words_ = docs.select(field(id_col).alias("doc_id"), lower.alias("lower")).where(
        F.col("lower").rlike(rf"(?<![a-z0-9])(?:{'|'.join(guards)})(?![a-z0-9])"))
    words_ = words_.select("doc_id", F.regexp_extract_all("lower", F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    guard_list = F.array(*[F.lit(g) for g in guards])
    at = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains(guard_list, F.element_at("words", i)))
    prepared = words_.where(F.size("words") >= words).select("doc_id", _shingles(F.col("words"), words).alias("all"), at.alias("guards"))
    sized = prepared.select("doc_id", "all", "guards", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    # window k of a class holds the shingles k * class + 1 to (k + 2) * class; shingle i holds the words i to i + words - 1
    near = F.transform("guards", lambda p: F.sequence(
        F.greatest(F.lit(0), F.ceil((p - (words - 1) - 2 * F.col("class")) / F.col("class")).cast("int")), F.floor((p - 1) / F.col("class")).cast("int")))
    cut = sized.select("doc_id", "all", "class", F.explode(F.array_distinct(F.flatten(near))).alias("k"))
    cut = cut.select("doc_id", "class", "k", F.slice("all", F.col("k") * F.col("class") + 1, 2 * F.col("class")).alias("window")).where(F.size("window") > 0)
    met = cut.select("doc_id", "class", "k", "window", F.posexplode(_signature(F.col("window"), bands)).alias("band", "value"))
    # the templates are a parameter: one row for each template and band
    met = met.join(F.broadcast(banded), ["class", "band", "value"]).select("doc_id", "k", "class", "window", "license", "own").distinct()
    shared = F.array_intersect("window", "own")
    met = met.select("doc_id", "license", (F.size(shared) / F.size("own")).alias("containment"),
                     (F.col("k") * F.col("class") + F.array_min(F.transform(shared, lambda h: F.array_position("window", h))) - 1).alias("at"))
    best = F.max(F.struct("containment", (-F.col("at")).alias("place"))).alias("best")
    return met.where(F.col("containment") * 100 >= percent - 1e-9).groupBy("doc_id", "license").agg(best).select(
        "doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.place")).cast("long").alias("first_word"))
