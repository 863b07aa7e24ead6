import math
import re
from collections import Counter

import pytest

from glossweave.llm import licenses
from glossweave.llm.queries import QUERIES, as_files

FOLDER = "/root/testdata/sf0.01"


def _plain(files, least=0.8):
    """path -> (licence, cosine, inherited_from) by loops."""
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    vocabulary = {w for ts in licenses.TEMPLATES.values() for t in ts for w in words(t)}
    df = Counter(w for _, t in files for w in set(words(t or "")) & vocabulary)
    idf = lambda w: math.log((len(files) + 1) / (df[w] + 1)) + 1 if w in vocabulary else math.log(len(files) + 1) + 1
    vector = lambda t: {w: c * idf(w) for w, c in Counter(words(t)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = {}
    for path, text in files:
        for line in (text or "").split("\n"):
            v = vector(line)
            if path is None or not v or not re.search(licenses.MARKS, line):
                continue
            for name, ts in sorted(licenses.TEMPLATES.items()):
                for t in ts:
                    u = vector(t)
                    cosine = sum(v.get(w, 0) * x for w, x in u.items()) / size(u) / size(v)
                    if cosine >= least and cosine > own.get(path, ("", -1))[1] + 1e-12:
                        own[path] = (name, cosine)
    out = {}
    for path, _ in files:
        if path is None:
            continue
        out[path] = (*own[path], None) if path in own else (None, None, None)
        at = path
        while path not in own and at:
            at = at.rpartition("/")[0]
            here = [(-c, n) for p, (n, c) in own.items() if p.rpartition("/")[0] == at and re.match(licenses.LICENCE_FILE, p.rpartition("/")[2])]
            if here:
                out[path] = (min(here)[1], -min(here)[0], at)
                break
    return out


def _same(rows, want):
    for r in rows:
        licence, cosine, source = want[r.path] if r.path is not None else (None, None, None)
        assert (r.licence, r.inherited_from) == (licence, source), r
        assert r.cosine == (pytest.approx(cosine) if cosine is not None else None)


def test_query_against_loops(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    files = [(r.path, r.text) for r in as_files(docs).collect()]
    rows = QUERIES["op4_licenses"](spark, FOLDER).collect()
    assert len(rows) == len(files) and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    _same(rows, _plain(files))
    assert sum(r.inherited_from is not None for r in rows) > 5 and sum(r.licence == "MIT" for r in rows) > 5


def test_edges(spark):
    mit = licenses.TEMPLATES["MIT"][0]
    files = [
        ("a/LICENSE", f"x\n{mit}"), ("a/b/c.py", "code"), ("a/b/LICENSE.txt", licenses.TEMPLATES["GPL-3.0"][1]),
        ("a/b/d/e/f.py", None), ("g.py", ""), ("a/h.py", "word " * 20_000 + "license"), ("a/i.py", licenses.TEMPLATES["BSD-3-Clause"][0]),
        (None, mit), ("LICENSE", "licence unknown"), ("a/COPYING", licenses.TEMPLATES["Apache-2.0"][0]), ("a/b/c.py", "code"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    rows = licenses.licences(df).collect()
    assert len(rows) == len(files)
    _same(rows, _plain(files))
    assert licenses.licences(df.limit(0)).count() == 0


MIT = """Copyright (c) 2021 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Copyright (c) 2020, A. Person. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
NEITHER = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
import os"""
GPL_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed."""
APACHE = """/* Copyright 2019 A. Person
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *     http://www.apache.org/licenses/LICENSE-2.0 */"""


@pytest.mark.parametrize("text, licence", [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "CC-BY-NC-SA-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("// SPDX-License-Identifier: Zlib", "unknown"),
    ("Licensed under the BSD License.", "unknown"), ("Licensed under the Zlib License.", "unknown"),
    ("This work is licensed under the GNU General Public License.", "unknown"),
    ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
    (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + NEITHER, "BSD-3-Clause"), (GPL.format(2), "GPL-2.0"), (GPL.format(3), "GPL-3.0"),
    (GPL.format(3).replace("GNU General", "GNU Affero General"), "AGPL-3.0"), (GPL_TEXT, "GPL-3.0"), (APACHE, "Apache-2.0"),
])
def test_notices(declared_as, text, licence):
    assert declared_as[text] == (licence, None)


@pytest.fixture(scope="module")
def declared_as(spark, request):
    """Each text of test_notices, below a licence file of another kind: its licence and where it is from."""
    texts = [p[0] for m in test_notices.pytestmark for p in m.args[1]]
    files = [("LICENSE", licenses.TEMPLATES["ISC"][0])] + [(f"f{n}.py", t) for n, t in enumerate(texts)]
    files += [(f"other{n}.py", f"plain code {n}") for n in range(100)]
    rows = licenses.licences(spark.createDataFrame(files, "path string, text string")).collect()
    got = {r.path: (r.licence, r.inherited_from) for r in rows}
    assert got["other0.py"] == ("ISC", "")
    return {t: got[f"f{n}.py"] for n, t in enumerate(texts)}
