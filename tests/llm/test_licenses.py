"""Held-out accuracy, known notices in the table, native plans and edges."""

import numpy as np

from tessera.llm import licenses as L

PLANTED = (("Apache License", "apache"), ("MIT License", "mit"), ("GNU General", "gpl"), ("CC BY-NC", "cc-by-nc"), ("All rights reserved", "all-rights-reserved"))


def test_held_out_variations():
    names, w, b = L.train()
    texts, truth = L.examples(9, 5)
    guess = np.array(names)[np.argmax(L._matrix(texts) @ w + b, 1)]
    assert np.mean(guess == np.array(truth)) > 0.97
    unknown = np.array(truth) == L.UNKNOWN
    assert np.mean(guess[unknown] == L.UNKNOWN) > 0.97


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = L.op9_license_scans(spark, folder)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString().replace("PythonUDF", "")
    for r in found.collect():
        want = ",".join(sorted({family for words, family in PLANTED if words in texts[r["doc_id"]]}))
        assert r["families"] == want
        assert r["n_paragraphs"] == len(__import__("regex").split(r"\n(?:[^\p{L}\p{N}\n]*\n)+", texts[r["doc_id"]]))


def test_agrees_with_the_numpy_model(spark):
    names, w, b = L.train()
    texts, _ = L.examples(4, 1)
    found = L.scan(spark.createDataFrame([(t,) for t in texts], "text string"), least=0.0, alike=0.0).collect()
    z = L._matrix(texts) @ np.round(w, 4) + b
    for r, score in zip(found, z, strict=True):
        best = names[int(np.argmax(score))]
        assert [x["family"] for x in r["licenses"]] == ([] if best == L.UNKNOWN else [best])
        if r["licenses"]:
            p = 1 / np.exp(score - score.max()).sum()
            assert abs(r["licenses"][0]["probability"] - p) < 1e-3


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x\nReleased under the MIT License\n\nLicensed under the Apache License, Version 2.0", None), (4, "license", "c"), (4, "license", "c"), (5, "the " * 50_000 + "\nReleased under the MIT License", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    found = L.scan(df)
    assert found.columns == ["doc_id", "text", "licenses", "n_paragraphs", "licenses_"]
    assert [[(x["paragraph"], x["family"]) for x in r["licenses_"]] for r in found.collect()] == [[], [], [(0, "mit"), (1, "apache")], [], [], [(0, "mit")]]
    assert L.scan(df.limit(0)).count() == 0


_GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
_LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
_BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:"""


_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""


def test_cues_lose_nothing():
    """Whoever has none of the cues lacks too many pairs of every template to count."""
    for alike in (0.3, L.ALIKE, 0.9):
        words = set(L.cues(alike))
        for notices in L.TEMPLATES.values():
            for every in map(L.pairs, notices):
                assert sum(not words & set(p.split()) for p in every) < alike * len(every)
    assert L.cues(0.0) == []


def test_wrapped_headers(spark):
    comment = lambda text, mark: "\n".join(mark + line for line in text.split("\n"))
    cases = [
        (_GPL, [(0, "gpl")]),
        (_LGPL, [(0, "lgpl")]),
        (_GPL.replace("GNU General", "GNU Affero General"), [(0, "agpl")]),
        (_BSD, [(0, "bsd")]),
        (comment(_GPL, " * "), [(0, "gpl")]),
        (comment(_LGPL, "# "), [(0, "lgpl")]),
        (f"int x;\n\n{_GPL}\n *\n{_BSD}\n\nReleased under the MIT License\nand more", [(1, "gpl"), (2, "bsd"), (3, "mit")]),
        ("This work is dedicated to the public\ndomain under CC0 1.0", [(0, "public-domain")]),
        ("word " * 5000 + _BSD, [(0, "bsd")]),
        (_ISC, [(0, "isc")]),
        (comment(_ISC, "// "), [(0, "isc")]),
        (_MIT, [(0, "mit"), (1, "mit")]),
        (_APACHE, [(0, "apache"), (1, "apache")]),
        (comment(_APACHE, " * "), [(0, "apache"), (1, "apache")]),
        (_MPL, [(0, "mpl")]),
        (_EPL, [(0, "epl")]),
        ("one two three\n" * 400 + _ISC + "\n" + "four five six\n" * 400, [(0, "isc")]),
        # a blank line parts a notice
        (_BSD.replace("without\n", "without\n\n"), []),
    ]
    found = L.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")).orderBy("i").collect()
    assert [[(x["paragraph"], x["family"]) for x in r["licenses"]] for r in found] == [want for _, want in cases]


def test_other_forms(spark):
    """Short names, other versions and suffixes, and families that have few notices."""
    cases = [
        ("The MIT License (MIT)", "mit"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl"),
        ("SPDX-License-Identifier: GPL-2.0-only", "gpl"),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
        ("SPDX-License-Identifier: BSD-2-Clause", "bsd"),
        ("Creative Commons Attribution 3.0 Unported", "cc-by"),
        ("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.", "cc-by-nc"),
        ("// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file.", "bsd"),
        ("The contents of this file are subject to the terms of the\nCommon Development and Distribution License", "cddl"),
        ("This product includes software developed by the OpenSSL Project\nfor use in the OpenSSL Toolkit. (http://www.openssl.org/)", "openssl"),
        ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "wtfpl"),
        ("The MIT campus is open to the public", ""),
        ("an open toolkit for the project was developed", ""),
        ("SPDX-License-Identifier: LicenseRef-Another-2.0", ""),
        ("the identifier of the driver's license is GP-2.0", ""),
    ]
    found = L.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")).orderBy("i").collect()
    assert [",".join(x["family"] for x in r["licenses"]) for r in found] == [want for _, want in cases]
