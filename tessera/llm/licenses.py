"""License scans: paragraphs that grant or name a licence, by family.

Method: a multinomial logistic regression on hashed word 1- to 3-grams, trained here in numpy on variations of the
families' usual notices and on paragraphs that are none (near misses among them), with a class "unknown", and
calibrated by a temperature on held-out variations. A prediction counts if its probability is LEAST or more and what is
judged holds ALIKE of the word pairs of one of the family's templates.

A paragraph is what stands between blank lines (those without letters and digits, such as an empty comment line), its
lines joined. Each line of it is judged alone, and so is every stretch of twice REACH words, from each REACH-th word on,
where REACH is the length of the longest template: a notice wrapped over lines is whole in one of them. Of one
family's finds in a paragraph the most similar counts, of equal ones the most probable; a find all of whose matching
pairs a more similar find of another family in the paragraph has too does not count.

Everything on the main path is a DataFrame function: weights and templates are literals of a fixed size, a document's
paragraphs are an array, and no row is exploded or shuffled. Lines and stretches without any cue word are not judged;
that loses nothing: cues() takes so many words of each template that whoever lacks them all lacks too many of its pairs
to count.

Edge cases: a null or empty text has one paragraph and no licences; rows with null or repeated ids are scanned each; an
empty table gives an empty result; other columns pass through, whatever their names; a paragraph of any length is
judged whole.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

PLACES, GRAMS, LEAST, ALIKE = 32768, 3, 0.5, 0.6
UNKNOWN = "unknown"
#: Usual notices of licence families. Fixed values.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License", "licensed under the GNU Affero General Public License version 3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL"],
    "all-rights-reserved": ["Copyright. All rights reserved.", "All rights reserved. No part may be reproduced without written permission"],
    "apache": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License 2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "artistic": ["licensed under the Artistic License 2.0", "under the same terms as Perl itself, under the Artistic License", "SPDX-License-Identifier: Artistic-2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0", "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", "SPDX-License-Identifier: BSL-1.0"],
    "bsd": ["licensed under the BSD License", "Released under the 3-Clause BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 3.0 Unported License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "cddl": ["subject to the terms of the Common Development and Distribution License", "licensed under the CDDL, version 1.0", "SPDX-License-Identifier: CDDL-1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "licensed under the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "Released under the GPL v3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL"],
    "isc": ["licensed under the ISC License", "Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "SPDX-License-Identifier: ISC"],
    "lgpl": ["licensed under the GNU Lesser General Public License, version 2.1", "Released under the LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL"],
    "mit": ["Released under the MIT License", "The MIT License (MIT)", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "SPDX-License-Identifier: MIT"],
    "mpl": ["subject to the terms of the Mozilla Public License, v. 2.0", "Released under the Mozilla Public License 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "SPDX-License-Identifier: MPL-2.0"],
    "openssl": ["This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit", "Licensed under the OpenSSL license", "SPDX-License-Identifier: OpenSSL"],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0", "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: CC0-1.0"],
    "wtfpl": ["Do What The Fuck You Want To Public License", "Released under the WTFPL", "SPDX-License-Identifier: WTFPL"],
    "zlib": ["licensed under the zlib License", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "SPDX-License-Identifier: Zlib"],
}
#: Paragraphs with licence words that grant nothing. Fixed values.
NEAR_MISSES = ["a driver's license is needed to rent a car", "the license plate was stolen last night", "he was licensed to practise medicine in two states", "the apache helicopter landed near the base", "a gnu is a large antelope of africa", "she studied at mit before she moved", "the bar lost its liquor license", "copyright law differs from one country to the next", "permission to leave was granted by the teacher", "the public domain name was sold", "the mozilla headquarters moved", "public hearings are open to any person", "creative work is done in common", "the commons were open to all", "please read the license before you install this software", "fishing licenses are sold at the lake", "SPDX-License-Identifier: LicenseRef-Internal", "SPDX-License-Identifier: Proprietary-1.0"]
#: Words to look for first; cues() adds those of a template that these do not settle. Fixed values.
CUES = ["licensed", "license", "copyright", "apache", "gnu", "affero", "lesser", "gpl", "lgpl", "agpl", "mit", "bsd", "mozilla", "mpl", "creative", "commons", "cc", "cc0", "reserved", "hereby", "redistribution", "redistribute", "spdx", "unencumbered", "isc", "eclipse", "boost", "artistic", "zlib", "wtfpl", "openssl", "cddl"]
#: Between paragraphs: blank lines.
BREAK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
_FILLER = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must through years where much your way well down should because long each just state those people too mr how little good world make very year still see own work men day get here".split()


def normal(text: str) -> str:
    """Small letters and digits, single blanks."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


#: Words of the longest template.
REACH = max(len(normal(t).split()) for notices in TEMPLATES.values() for t in notices)


def _grams(text: str) -> list[str]:
    w = normal(text).split()
    return [" ".join(w[i : i + n]) for n in range(1, GRAMS + 1) for i in range(len(w) - n + 1)]


def pairs(notice: str) -> list[str]:
    """The word pairs of a notice."""
    w = normal(notice).split()
    return sorted({f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)})


def cues(alike: float) -> list[str]:
    """Words of which a text has at least one if it holds this share of any template's pairs; none if the share is 0.

    With n pairs, of which k are asked for, a template is settled once fewer than k of them are free of these words.
    """
    out = list(CUES)
    for notices in TEMPLATES.values():
        for notice in notices:
            every = pairs(notice)
            asked = int(np.ceil(alike * len(every) - 1e-9))
            if asked < 1:
                return []
            while len(free := [p for p in every if not set(p.split()) & set(out)]) >= asked:
                left = [w for p in free for w in p.split()]
                out.append(min(set(left), key=lambda w: (w in _FILLER, -left.count(w), -len(w), w)))
    return sorted(out)


def _place(gram: str) -> int:
    return zlib.crc32(gram.encode()) % PLACES


def examples(seed: int, copies: int) -> tuple[list[str], list[str]]:
    """Variations: words dropped, others before and behind; for "unknown", near misses, mixed words of notices, filler."""
    rng = np.random.Generator(np.random.PCG64(seed))
    invented = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 10)))
    noise = lambda n: " ".join(invented() if rng.random() < 0.3 else rng.choice(_FILLER) for _ in range(n))
    texts, names = [], []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            w = normal(notice).split()
            for i in range(copies):
                kept = [x for x in w if rng.random() > 0.04] or w
                most = 9 if i % 3 == 2 else 32
                texts.append(f"{noise(rng.integers(0, most))} {' '.join(kept)} {noise(rng.integers(0, most))}")
                names.append(family)
    every = [x for notices in TEMPLATES.values() for n in notices for x in normal(n).split()]
    for _ in range(copies * 20):
        texts.append(noise(rng.integers(3, 60)))
        texts.append(f"{noise(rng.integers(0, 30))} {rng.choice(NEAR_MISSES)} {noise(rng.integers(0, 12))}")
        texts.append(" ".join(rng.permutation(np.concatenate([rng.choice(every, 3), rng.choice(_FILLER, rng.integers(4, 12))]))))
        names += [UNKNOWN] * 3
    return texts, names


def _matrix(texts: list[str], places: np.ndarray | None = None) -> np.ndarray:
    """Which places (all, or those given) each text has."""
    at = np.arange(PLACES) if places is None else np.full(PLACES, len(places))
    if places is not None:
        at[places] = np.arange(len(places))
    x = np.zeros((len(texts), (PLACES if places is None else len(places)) + 1), np.float32)
    for i, text in enumerate(texts):
        x[i, at[[_place(g) for g in _grams(text)]]] = 1
    return x[:, :-1]


@cache
def train(copies: int = 60, steps: int = 600) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Families, sparse weights (places by families) and biases, the calibrating temperature divided in."""
    names = [*sorted(TEMPLATES), UNKNOWN]
    texts, labels = examples(1, copies)
    # only places that some texts have can learn
    used = np.flatnonzero(np.bincount([p for t in texts for p in {_place(g) for g in _grams(t)}], minlength=PLACES) > 24)
    x, y = np.ascontiguousarray(_matrix(texts, used)), np.array([names.index(n) for n in labels])
    w, b = np.zeros((len(used), len(names)), np.float32), np.zeros(len(names), np.float32)
    target = np.eye(len(names), dtype=np.float32)[y] / np.bincount(y)[y][:, None] * len(y) / len(names)
    squares = np.full_like(w, 1e-3)
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(steps):
        some = rng.integers(0, len(y), 256)
        z = x[some] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) * target[some].sum(1, keepdims=True)
        grad = x[some].T @ (p - target[some]) / len(some) + 1e-3 * w
        squares += grad * grad
        w -= 0.3 * grad / np.sqrt(squares)
        b -= 0.1 * (p - target[some]).mean(0)
    w[np.abs(w) < 0.02] = 0
    w, small = np.zeros((PLACES, len(names)), np.float32), w
    w[used] = small
    held, truth = examples(2, 3)
    z, t = _matrix(held) @ w + b, np.array([names.index(n) for n in truth])
    loss = lambda k: -np.mean((s := z / k)[np.arange(len(t)), t] - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) - s.max(1))
    heat = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    return names, w / heat, b / heat


def _let(value: Column, body) -> Column:
    """body of value, with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def scan(docs: DataFrame, text: str = "text", least: float = LEAST, alike: float = ALIKE) -> DataFrame:
    """All columns of docs, then n_paragraphs and licenses: an array of paragraph (from 0), family, probability, similarity."""
    names, w, b = train()
    rows = [[round(float(v), 4) for v in r] if r.any() else [] for r in w]
    weights = F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")
    known = F.from_json(F.lit(json.dumps([[pairs(t) for t in TEMPLATES.get(n, [])] for n in names])), "array<array<array<string>>>")
    family = F.from_json(F.lit(json.dumps(names)), "array<string>")
    n_columns, licenses = fresh(docs, "n_paragraphs", "licenses")
    cue = cues(alike)
    said = (lambda c: c.rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(cue)})(?![a-z0-9])")) if cue else (lambda c: F.lit(True))
    cued = (lambda t: F.arrays_overlap(t, F.array(*[F.lit(w) for w in cue]))) if cue else (lambda t: F.lit(True))

    def grams(tokens: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")) if n > 1 else tokens

    def split(paragraph: Column) -> Column:
        return F.filter(F.split(F.lower(paragraph), r"[^a-z0-9]+"), lambda t: t != "")

    def judge(tokens: Column, i: Column, lit: Column) -> Column:
        def scored(tokens: Column) -> Column:
            every = F.concat(*[F.when(F.size(tokens) >= n, grams(tokens, n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAMS + 1)])
            places = F.array_distinct(F.transform(every, lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(PLACES)).cast("int")))
            hit = F.filter(F.transform(places, lambda p: F.get(lit["w"], p)), lambda r: F.size(r) > 0)
            start = F.array(*[F.lit(float(x)) for x in b])
            total = F.reduce(hit, start, lambda acc, r: F.zip_with(acc, r, lambda x, y: x + y))

            def best(z: Column) -> Column:
                top = F.array_max(z)
                at = (F.array_position(z, top) - 1).cast("int")
                p = 1 / F.reduce(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda acc, v: acc + v)
                own = F.array_distinct(F.when(F.size(tokens) >= 2, grams(tokens, 2)).otherwise(F.array().cast("array<string>")))
                share = lambda t: _let(F.array_intersect(t, own), lambda m: F.struct((F.size(m) / F.greatest(F.size(t), F.lit(1))).alias("s"), m.alias("m")))
                match = _let(F.array_max(F.transform(F.get(lit["k"], at), share)), lambda m: F.struct(F.coalesce(m["s"], F.lit(0.0)).alias("s"), m["m"].alias("m")))
                return _let(match, lambda m: F.struct(i.cast("int").alias("paragraph"), F.get(lit["f"], at).alias("family"), p.alias("probability"), m["s"].alias("similarity"), m["m"].alias("matched")))

            return _let(total, best)

        return _let(tokens, scored)

    def counts(r: Column) -> Column:
        return (r["family"] != UNKNOWN) & (r["probability"] >= least) & (r["similarity"] >= alike)

    def stretches(p: Column) -> Column:
        """The words of each line, and of each stretch of a paragraph that is not one short line."""
        lines = F.split(p, "\n")

        def cut(tokens: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(REACH))
            more = F.filter(F.transform(starts, lambda i: F.slice(tokens, i, 2 * REACH)), cued)
            return F.when((F.size(lines) > 1) | (F.size(tokens) > 2 * REACH), more).otherwise(F.array().cast("array<array<string>>"))

        return F.concat(F.transform(F.filter(lines, said), split), _let(split(p), cut))

    def judged(paragraphs: Column) -> Column:
        literal = F.struct(weights.alias("w"), known.alias("k"), family.alias("f"))
        numbered = F.filter(F.transform(paragraphs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda s: said(s["p"]))
        finds = lambda lit: F.flatten(F.transform(numbered, lambda s: F.filter(F.transform(stretches(s["p"]), lambda t: judge(t, s["i"], lit)), counts)))

        def best(found: Column) -> Column:
            same = lambda o, r: o["paragraph"] == r["paragraph"]
            better = lambda o, r: (o["family"] == r["family"]) & ((o["similarity"] > r["similarity"]) | ((o["similarity"] == r["similarity"]) & (o["probability"] > r["probability"])))
            # a part of another family's notice, cut at the end of a stretch
            explains = lambda o, r: (o["family"] != r["family"]) & (o["similarity"] > r["similarity"]) & (F.size(F.array_except(r["matched"], o["matched"])) == 0)
            left = F.filter(found, lambda r: ~F.exists(found, lambda o: same(o, r) & (better(o, r) | explains(o, r))))
            return F.array_sort(F.array_distinct(F.transform(left, lambda r: F.struct(*[r[c].alias(c) for c in ("paragraph", "family", "probability", "similarity")]))))

        return _let(_let(literal, finds), best)

    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,similarity:double>>")
    paragraphs = F.split(body, BREAK)
    return docs.withColumns({n_columns: F.size(paragraphs).cast("long"), licenses: F.when(said(body), judged(paragraphs)).otherwise(none)})


def op9_license_scans(spark, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    best = F.array_max(F.transform("licenses", lambda r: F.struct(r["probability"], r["family"], r["similarity"], r["paragraph"])))
    return found.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda r: r["family"]))), ",").alias("families"), best["paragraph"].alias("paragraph"), best["probability"].alias("probability"), best["similarity"].alias("similarity"))
