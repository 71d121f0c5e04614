"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

All of it is DataFrame work in Spark's own functions. The passages of a text are its lines, runs of two and four lines, and its blocks
between lines without letters or digits; a file named like a licence file is also a passage as a whole. Each
passage is compared with every template by the cosine of their terms (each distinct word once, weighted by how rare it is among the texts of the
table; words that no template has weigh as the mean of those that one has). A template names a licence only where the passage has all its
naming words. Texts without any of the heavy words of a template are left out first: without them no cosine reaches the threshold.

A licence whose text holds all of another's (WIDER) takes its place if a passage reaches it too. An SPDX tag that joins several known licences by OR, AND or WITH names the whole
expression.

A file named like a licence file speaks for its directory, and a file without a licence of its own takes that
of its nearest directory upwards that has one: distinct directories are joined to their ancestors, files to directories.

Defined results. A null or empty text has no licence of its own. A null path belongs to no directory and inherits
nothing. Of several licence files in a directory the most similar counts, then the smaller licence id. Ties between templates go
to the one with more naming words, then to the smaller licence id. Texts are taken whole, whatever their length. Repeated rows give equal results. An empty table gives an empty result. Columns of the input
that have the name of one of the operator's own are replaced.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, spare, without

#: Least cosine of a licence.
THRESHOLD = 0.6
#: Lines that are also compared together.
RUNS = (2, 4)
LICENSE_NAME = r"(?i)(^|/)(licen[sc]es?|copying|copyright|unlicense|notice)([._-][^/]*)?$"
OWN = ("license", "similarity", "origin", "inherited_from")

#: By licence id the words that name it, beside those of the id, and texts as their licences word them.
NAMES = {
    "AGPL-3.0": "gnu affero general public version",
    "Apache-2.0": "apache",
    "BSD-2-Clause": "bsd",
    "BSD-3-Clause": "bsd neither",
    "CC0-1.0": "cc0 zero",
    "GPL-2.0": "gnu general public",
    "GPL-3.0": "gnu general public",
    "ISC": "isc",
    "LGPL-2.1": "gnu lesser general public",
    "LGPL-3.0": "gnu lesser general public",
    "MIT": "mit",
    "MPL-2.0": "mozilla public",
    "Unlicense": "unlicense unencumbered",
}
TEXTS = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "GNU Affero General Public License Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC0-1.0": [
        "Dedicated to the public domain under CC0 1.0 Universal",
        "Creative Commons CC0 1.0 Universal Public Domain Dedication",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights to the work worldwide under copyright law",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Released under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License",
        "MIT License",
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under the Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
#: Licences that hold all of another's text and more.
WIDER = {"BSD-2-Clause": "BSD-3-Clause"}
#: An SPDX tag and its expression, and what joins the licences of one.
SPDX = r"SPDX-License-Identifier:[ \t]*(\(?[A-Za-z0-9.+-]+\)?(?:[ \t]+(?:OR|AND|WITH)[ \t]+\(?[A-Za-z0-9.+-]+\)?)+)"
JOINS = r"[ \t]+(?:OR|AND|WITH)[ \t]+"
#: The parts of Creative Commons licences and their names.
CREATIVE = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}


def words_in(text: str) -> set[str]:
    return {w for w in re.split(r"[\W_]+", text.lower()) if w}


def templates() -> list[tuple[str, str, set[str]]]:
    """Licence, text, and the words that a passage must have: the texts above, Creative Commons notices and SPDX tags by rule."""
    texts = {k: list(v) for k, v in TEXTS.items()}
    for parts in (["BY"], ["BY", "SA"], ["BY", "NC"], ["BY", "ND"], ["BY", "NC", "SA"], ["BY", "NC", "ND"]):
        texts[f"CC-{'-'.join(parts)}-4.0"] = [f"Licensed under CC {'-'.join(parts)} 4.0", f"This work is licensed under a Creative Commons {'-'.join(CREATIVE[p] for p in parts)} 4.0 International License"]
    out = []
    for name, of in sorted(texts.items()):
        naming = words_in(name) | words_in(NAMES.get(name, "")) | (words_in(" ".join(CREATIVE.values())) if name.startswith("CC-") else set())
        out += [(name, text, words_in(text) & naming) for text in [*of, f"SPDX-License-Identifier: {name}"]]
    return out


def words_of(text: Column) -> Column:
    """The distinct lower-case words and numbers of a text."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def heavy(weights: dict[str, float], threshold: float) -> set[str]:
    """The heaviest words of a template: those left have less than the square of the threshold of its squared length, so a passage without any heavy word stays below the threshold."""
    total = sum(w * w for w in weights.values())
    out, rest = set(weights), 0.0
    for word, w in sorted(weights.items(), key=lambda x: (x[1], x[0])):
        rest += w * w
        if rest >= 0.999 * threshold**2 * total:
            break
        out.discard(word)
    return out


def passages(text: Column, whole: Column) -> Column:
    lines = F.split(text, r"\r?\n")

    def runs(k: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(lines) - (k - 1)), lambda i: F.concat_ws("\n", F.slice(lines, i, F.lit(k))))
        return F.when(F.size(lines) >= k, found).otherwise(F.array().cast("array<string>"))

    out = [lines, *map(runs, RUNS)]
    out.append(F.split(text, r"\n[^\p{L}\p{N}\n]*(?=\n)"))
    out.append(F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*out))


def scan(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", known: list[tuple[str, str, set[str]]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without its text, with ``license``, ``similarity``, ``origin`` (file, header, inherited or none) and ``inherited_from``."""
    known = templates() if known is None else known
    vocabulary = sorted({w for _, text, _ in known for w in words_in(text)})
    words = lambda of: F.array(*[F.lit(w) for w in sorted(of)]) if of else F.array().cast("array<string>")
    base = without(df, *[o for o in OWN if o not in (id_col, path_col, text_col)])
    score_, dir_, own_, parts_, wide_, tag_ = spare(base, "_score", "_dir", "_own", "_parts", "_wide", "_tag")

    # How many texts have each word of a template: as many rows as the templates have words.
    counted = base.select(F.explode(F.array_intersect(F.concat(F.array(F.lit("")), words_of(F.coalesce(text_col, F.lit("")))), words([*vocabulary, ""]))).alias("t"))
    found = {r["t"]: r["n"] for r in counted.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = found.get("", 0)
    idf = {t: math.log((1 + total) / (1 + found.get(t, 0))) + 1 for t in vocabulary}
    other = (sum(idf.values()) / max(1, len(idf))) ** 2
    telling = words(set().union(*[heavy({w: idf[w] for w in words_in(text)}, threshold) for _, text, _ in known]))
    # Of each word of a template: its weight, its share of the product with every template, and the templates that it names.
    share = {t: {"w": idf[t] ** 2, "d": [idf[t] ** 2 if t in words_in(text) else 0.0 for _, text, _ in known], "m": [int(t in must) for _, _, must in known]} for t in vocabulary}
    share_of = F.from_json(F.lit(json.dumps(share)), "map<string, struct<w: double, d: array<double>, m: array<int>>>")
    facts = [{"n": len(must), "l": name, "size": math.sqrt(sum(idf[t] ** 2 for t in words_in(text)))} for name, text, must in known]
    about = F.from_json(F.lit(json.dumps(facts)), "array<struct<n: int, l: string, size: double>>")

    def best_of(own: Column, wanted: Column) -> Column:
        """The best template for a passage of these words, of those of which ``wanted`` is true: (negated similarity, negated number of naming words, licence)."""
        hits = F.transform(F.array_intersect(own, words(vocabulary)), lambda t: share_of[t])
        added = lambda field, zero: F.aggregate(hits, F.array_repeat(F.lit(zero), len(known)), lambda a, h: F.zip_with(a, h[field], lambda x, y: x + y))
        norm = F.sqrt(F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["w"]) + (F.size(own) - F.size(hits)) * F.lit(other))
        facts_of = F.arrays_zip(about.alias("t"), added("d", 0.0).alias("d"), added("m", 0).alias("m"), wanted.alias("ok"))

        def option(x: Column, norm: Column) -> Column:
            score = F.when(x["ok"] & (x["m"] == x["t"]["n"]), F.round(F.try_divide(x["d"], norm * x["t"]["size"]), 9)).otherwise(F.lit(0.0))
            return F.struct((-F.coalesce(score, F.lit(0.0))).alias("s"), (-x["t"]["n"]).alias("m"), x["t"]["l"].alias("l"))

        # A lambda's argument is worked out once; the array of one holds what all templates need.
        once = F.array(F.struct(norm.alias("norm"), facts_of.alias("facts")))
        return F.element_at(F.transform(once, lambda z: F.array_min(F.transform(z["facts"], lambda x: option(x, z["norm"])))), 1)

    text = F.col(text_col)
    is_file = F.coalesce(F.col(path_col).rlike(LICENSE_NAME), F.lit(False))
    every = F.array_repeat(F.lit(True), len(known))
    # Each step is a column that the next ones read, so that none is worked out again for each place that names it.
    rows = base.withColumn(parts_, F.when(F.arrays_overlap(words_of(text), telling), F.filter(F.transform(passages(text, is_file), words_of), lambda w: F.arrays_overlap(w, telling))))
    rows = rows.withColumn(score_, F.array_min(F.transform(parts_, lambda own: best_of(own, every))))
    for narrow, wide in WIDER.items():
        asked = F.array(*[F.lit(name == wide and bool(must)) for name, _, must in known])
        rows = rows.withColumn(wide_, F.when(F.col(f"{score_}.l") == narrow, F.array_min(F.transform(parts_, lambda own: best_of(own, asked)))))  # noqa: B023  called at once
        rows = rows.withColumn(score_, F.when(F.col(f"{wide_}.s") <= -threshold, F.col(wide_)).otherwise(F.col(score_)))
    # Every part of an expression but what follows WITH must be a known licence, perhaps with "-only", "-or-later" or "+".
    rows = rows.withColumn(tag_, F.when(text.contains("SPDX-License-Identifier"), F.regexp_extract(text, SPDX, 1)))
    ids = F.split(F.regexp_replace(F.regexp_replace(tag_, r"[ \t]+WITH[ \t]+[^ \t)]+", ""), r"[()]", ""), JOINS)
    plain = F.transform(ids, lambda i: F.regexp_replace(i, r"(-only|-or-later|\+)$", ""))
    joined_ = (F.col(tag_) != "") & F.forall(plain, lambda i: i.isin(*sorted({name for name, _, _ in known})))
    rows = rows.withColumn(score_, F.when(joined_, F.struct(F.lit(-1.0).alias("s"), F.lit(0).alias("m"), F.col(tag_).alias("l"))).otherwise(F.col(score_)))
    scored = rows.withColumn(dir_, F.when(F.col(path_col).isNotNull(), F.regexp_replace(F.col(path_col), r"(^|/)[^/]*$", ""))).drop(parts_, wide_, tag_)
    held = materialize(scored.withColumn(own_, F.coalesce(F.col(f"{score_}.s") <= -threshold, F.lit(False))).drop(text_col), "licences")

    speaks = held.where(F.col(own_) & is_file).groupBy(F.col(dir_).alias("at")).agg(F.min(score_).alias("given"))
    dirs = held.where(F.col(dir_).isNotNull()).select(F.col(dir_).alias("dir")).distinct()
    steps = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", F.lit(0)).otherwise(F.size(steps))
    up = dirs.withColumn("k", F.explode(F.sequence(F.lit(0), depth))).withColumn("at", F.concat_ws("/", F.slice(steps, F.lit(1), F.col("k"))))
    nearest = up.join(speaks, "at").groupBy("dir").agg(F.max(F.struct("k", "at", "given")).alias("near"))
    joined = held.join(nearest, held[dir_] == nearest["dir"], "left")
    own = F.col(own_)
    inherits = ~own & F.col("near").isNotNull()
    result = {
        "license": F.when(own, F.col(f"{score_}.l")).when(inherits, F.col("near.given.l")),
        "similarity": F.when(own, -F.col(f"{score_}.s")).when(inherits, -F.col("near.given.s")),
        "origin": F.when(own & is_file, "file").when(own, "header").when(inherits, "inherited").otherwise("none"),
        "inherited_from": F.when(inherits, F.col("near.at")),
    }
    return joined.select(*[F.col(f"`{c}`") for c in base.columns if c != text_col], *[v.alias(k) for k, v in result.items()])
