"""Licences of files: TF-IDF cosine to templates, inherited from the nearest licensed directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm.common import cut, written

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT = (
    f"{_GRANT} The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_NEITHER = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_END = (
    " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License"
)


def _short(name: str, *more: str) -> list[str]:
    """Sentences that declare a licence by its name."""
    return [
        f"{begin} {each}." for each in (f"the {name}", *more)
        for begin in ("Licensed under", "This work is licensed under", "Released under", "Distributed under the terms of")
    ]


def _gnu(kind: str, version: str, short: str) -> list[str]:
    """Sentences, notices (this version, or a later one) and the head of the text of a GNU licence."""
    name = f"GNU {kind}General Public License"
    free = f"is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
    dates = {"1": "February 1989", "2": "June 1991", "2.1": "February 1999", "3": "June 2007" if kind != "Affero " else "November 2007"}
    return [
        *_short(f"{name}, version {version}", f"the {name} v{version}", f"{short} {version}", f"the {short} {version}"),
        f"This program {free}, version {version}.",
        f"This program {free}, version {version} of the License.",
        f"This program {free}, either version {version} of the License, or (at your option) any later version.",
        f"{name} Version {version}, {dates[version]} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to "
        "copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ]


def _creative(kinds: str, version: str, ending: str) -> list[str]:
    """Sentences that declare a Creative Commons licence, `kinds` being such as BY-NC."""
    full = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    name = "-".join(full[k] for k in kinds.split("-"))
    return _short(
        f"Creative Commons {name} {version} {ending} License", f"a Creative Commons {name} {version} {ending} License",
        f"a Creative Commons {name} {version} License", f"CC {kinds} {version}", f"CC {kinds} {version} License",
    )


#: Notices, sentences and texts of well-known licences, by SPDX identifier (fixed values). The texts of MIT, BSD
#: and ISC are whole; of the GNU licences, which fill pages, the head stands for the text.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files, to deal in the Software without restriction.",
        _GRANT, _MIT, *_short("MIT License", "MIT", "the MIT license (MIT)"),
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        f"{_APACHE}.",
        f"{_APACHE} at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
        "REPRODUCTION, AND DISTRIBUTION",
        *_short("Apache License, Version 2.0", "the Apache 2.0 License", "Apache 2.0"),
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, version 3.",
        *_gnu("", "3", "GPL"),
    ],
    "GPL-2.0": _gnu("", "2", "GPL"),
    "LGPL-2.1": _gnu("Lesser ", "2.1", "LGPL"),
    "LGPL-3.0": _gnu("Lesser ", "3", "LGPL"),
    "AGPL-3.0": _gnu("Affero ", "3", "AGPL"),
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met.",
        _BSD + _NEITHER, _BSD + _NEITHER + _BSD_END, *_short("BSD 3-Clause License", "the 3-Clause BSD License"),
    ],
    "BSD-2-Clause": [_BSD, _BSD + _BSD_END, *_short("BSD 2-Clause License", "the 2-Clause BSD License")],
    "ISC": [_ISC, _ISC + _ISC_END, *_short("ISC License")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions",
        *_short("Mozilla Public License, version 2.0", "MPL 2.0"),
    ],
    "CC-BY-4.0": [
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
        *_creative("BY", "4.0", "International"),
    ],
    **{
        f"CC-{kinds}-{version}": _creative(kinds, version, ending)
        for version, ending in (("4.0", "International"), ("3.0", "Unported"))
        for kinds in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") if (kinds, version) != ("BY", "4.0")
    },
    "CC0-1.0": _short("Creative Commons Zero 1.0 Universal License", "CC0 1.0", "the CC0 1.0 Universal License"),
    "proprietary": ["All rights reserved."],
}
#: What other licences' texts hold as well; looked at only where no other template of a file is near.
WEAK = {("proprietary", 0), ("BSD-3-Clause", 0)}
WORD = r"[a-z0-9]+"
#: A line or text without any of these declares nothing.
MARKS = (
    r"(?i)licen[cs]e|permission is hereby|permission to use|redistribution and use|free software|rights reserved|"
    r"(?:released|distributed) under"
)
#: Words by which a template is laid on a text: its first such word on each such word.
ANCHORS = ("licensed", "released", "distributed", "license", "permission", "redistribution", "rights")
#: Words that tell near templates apart, and what they say. A text must say the same of them.
NAMES = {"mit": "mit", "apache": "apache", "mozilla": "mpl", "mpl": "mpl", "bsd": "bsd", "isc": "isc", "gnu": "gnu", "gpl": "gnu",
         "lgpl": "gnu", "agpl": "gnu", "creative": "cc", "cc": "cc", "cc0": "cc0", "zero": "cc0"}
KINDS = {"noncommercial": "nc", "nc": "nc", "noderivatives": "nd", "noderivs": "nd", "nd": "nd", "sharealike": "sa", "sa": "sa"}
GNU_KINDS = {"lesser": "lesser", "lgpl": "lesser", "affero": "affero", "agpl": "affero"}
#: Spellings that are cut into the words of the templates.
SPELLINGS = (
    (r"(?<=gpl)[\s-]*v(?=[0-9])", " "), (r"(?<![a-z0-9])v(?=[0-9])", "version "), (r"gpl(?=[0-9])", "gpl "),
    (r"non[\s-]+commercial", "noncommercial"), (r"share[\s-]+alike", "sharealike"), (r"no[\s-]+deriv", "noderiv"),
)
#: A text that says so has a licence of its own, whether or not it is known here.
DECLARES = r"(?i)(?:licen[cs]ed|released|distributed)\s+under\s+(?:an?\s|the\s|terms\s)*[\w.,\s/-]{0,60}?(?:licen[cs]e|gpl|cc\s?by|bsd|mpl)|SPDX-License-Identifier:"
#: The clause that begins with neither may follow the end of a template that has none.
AFTER = 40
SPDX = r"SPDX-License-Identifier:[\x20\t]*([^\r\n*#<>]*[^\s*#<>/-])"
UNKNOWN = "unknown"
#: A file of this name is its directory's licence file.
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|notice)(?:[._-].*)?$"


def _words(text: str) -> list[str]:
    text = text.lower()
    for pattern, plain in SPELLINGS:
        text = re.sub(pattern, plain, text)
    return re.findall(WORD, text)


def _words_of(text: Column) -> Column:
    text = F.lower(text)
    for pattern, plain in SPELLINGS:
        text = F.regexp_replace(text, pattern, plain)
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _vocabulary() -> list[str]:
    return sorted({w for texts in TEMPLATES.values() for t in texts for w in _words(t)})


def _says(name: str, text: str) -> tuple[dict[str, str], list[str], list[str]]:
    """For a template: its deciding words, what it says of them, and the names it needs."""
    words = _words(text)
    decides = {}
    if name.startswith("CC"):
        decides |= KINDS
    if "GPL" in name:
        decides |= GNU_KINDS
    if name.startswith("BSD") and len(words) > 40:
        decides["neither"] = "neither"
    elif re.search(r"[0-9]", name):
        decides |= {d: d for d in "0123456789"}
    if "GPL" in name:  # version 3 is also written 3.0
        decides.pop("0")
    return (
        decides, sorted({decides[w] for w in words if w in decides}), sorted({NAMES[w] for w in words if w in NAMES})
    )


def _listed(values, kind: str = "string") -> str:
    """SQL for a fixed array; one literal of words, as thousands of them would take the planner long."""
    if not values:
        return f"cast(array() AS array<{kind}>)"
    return f"cast(split('{' '.join(map(str, values))}', ' ') AS array<{kind}>)"


def _map(of: dict, kind: str) -> str:
    return f"map_from_arrays({_listed(list(of))}, {_listed(list(of.values()), kind)})"


def _templates(idf: dict[str, float]) -> Column:
    """All templates as one array of structs."""
    out = []
    for name, texts in sorted(TEMPLATES.items()):
        for n, text in enumerate(texts):
            words = _words(text)
            counts = Counter(words)
            at = next(k for k, w in enumerate(words) if w in ANCHORS)
            decides, says, needs = _says(name, text)
            weak = (name, n) in WEAK
            if weak:
                decides, says = {}, []
            size = math.sqrt(sum((c * idf[w]) ** 2 for w, c in counts.items()))
            fields = {
                "licence": f"'{name}'", "weak": str(weak).lower(), "anchor": f"'{words[at]}'", "before": at, "length": len(words),
                "after": AFTER if "neither" in decides else 0, "size": f"{size!r}D",
                "weights": _map({w: c * idf[w] ** 2 for w, c in counts.items()}, "double"),
                "decides": _map(decides, "string"), "says": _listed(says), "needs": _listed(needs),
            }
            out.append(f"named_struct({', '.join(f"'{k}', {v}" for k, v in fields.items())})")
    return F.expr(f"array({', '.join(out)})")


def _norm(words: Column) -> Column:
    """Length of the TF-IDF vector of structs of word and weight: equal words in a row are one run."""
    begin = F.struct(
        F.lit("").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"),
    )
    ended = lambda s: s["sum"] + s["run"] * s["run"]

    def step(s: Column, w: Column) -> Column:
        same = s["word"] == w["word"]
        return F.struct(
            w["word"].alias("word"), F.when(same, s["run"] + w["idf"]).otherwise(w["idf"]).alias("run"),
            F.when(same, s["sum"]).otherwise(ended(s)).alias("sum"),
        )

    return F.aggregate(F.array_sort(words), begin, step, lambda s: F.sqrt(ended(s)))


def _is_said(words: Column, decides: Column, says: Column, needs: Column) -> Column:
    plain = F.transform(words, lambda w: w["word"])
    names = F.expr(_map(NAMES, "string"))
    found = F.array_distinct(F.filter(F.transform(plain, lambda w: F.try_element_at(decides, w)), lambda x: x.isNotNull()))
    called = F.transform(plain, lambda w: F.try_element_at(names, w))
    return (F.array_sort(found) == says) & (F.size(F.array_except(needs, called)) == 0)


def declared(
    files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = 0.8
) -> DataFrame:
    """Columns path, licence and cosine of the files whose text declares a licence.

    What is compared with the templates by the cosine of sparse TF-IDF vectors: each line that holds one of
    MARKS, whole; and, line ends or not, each stretch of words as long as a template that lies on the text
    with its first anchor word on the same word of the text. So a wrapped notice and a licence file are
    compared as wholes, wherever they begin. Of words that tell near templates apart (versions, kinds,
    names) text and template must say the same. A word's document frequency is counted over all files; words
    outside the templates' vocabulary weigh as much as a word that no file has. The best cosine decides,
    WEAK templates only without another; ties go to the licence that sorts first. An SPDX tag of one
    licence counts as 1. A file that declares (DECLARES) what no template is near to is UNKNOWN, without
    cosine.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    vocabulary = _vocabulary()
    in_text = F.array_intersect(
        F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.expr(_listed(vocabulary))
    )
    frequency = written(
        files.select(F.explode(in_text).alias("word")).groupBy("word").agg(F.count("*").alias("files_with"))
    )
    many = files.count()
    found = {r["word"]: r["files_with"] for r in frequency.collect()}  # at most the fixed vocabulary
    idf = {w: math.log((many + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary}
    other = math.log(many + 1) + 1
    marked = files.where(text.rlike(MARKS)).select(F.col(path_col).alias("path"), text.alias("text"))
    longest = max(len(_words(t)) for ts in TEMPLATES.values() for t in ts)

    lines = marked.select("path", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(MARKS))
    lines = lines.select("path", _words_of(F.col("line")).alias("words"), F.lit(None).cast("int").alias("at"))
    places = F.filter(
        F.transform("words", lambda w, k: F.when(w.isin(*ANCHORS), k)), lambda k: k.isNotNull()
    )
    # Around a place only as many words as a template can reach.
    laid = (
        marked.select("path", _words_of(F.col("text")).alias("words")).select("path", "words", F.explode(places).alias("k"))
        .withColumn("first", F.greatest(F.col("k") - longest, F.lit(0)))
        .select("path", F.slice("words", F.col("first") + 1, F.lit(2 * longest)).alias("words"), (F.col("k") - F.col("first")).alias("at"))
    )
    weights = F.expr(_map(idf, "double"))
    weighed = F.transform(
        "words", lambda w: F.struct(w.alias("word"), F.coalesce(F.try_element_at(weights, w), F.lit(other)).alias("idf"))
    )
    here = F.when(F.col("at").isNull(), F.lit(None).cast("string")).otherwise(F.get("words", F.col("at")))
    units = lines.union(laid).distinct().select("path", "at", here.alias("anchor"), weighed.alias("words"))
    of = F.explode(F.filter(
        _templates(idf), lambda t: F.col("anchor").isNull() | ((t["anchor"] == F.col("anchor")) & (t["before"] <= F.col("at")))
    ))
    def stretch(length: Column) -> Column:
        return F.when(F.col("at").isNull(), F.col("words")).otherwise(
            F.slice("words", F.col("at") - F.col("t.before") + 1, length)
        )

    product = F.aggregate(
        "part", F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(F.col("t.weights"), w["word"]), F.lit(0.0))
    )
    scored = (
        units.select("path", "at", "words", of.alias("t"))
        .where(_is_said(stretch(F.col("t.length") + F.col("t.after")), F.col("t.decides"), F.col("t.says"), F.col("t.needs")))
        .select("path", "t", stretch(F.col("t.length")).alias("part"))
        .select("path", "t.weak", "t.licence", (product / F.col("t.size") / _norm(F.col("part"))).alias("cosine"))
        .where(F.col("cosine") >= least)
    )
    # Equal texts differ in the last bits by the order of their sums.
    order = F.struct("weak", (-F.round("cosine", 12)).alias("less"), "licence", "cosine")
    near = scored.groupBy("path").agg(F.min(order).alias("of")).select("path", "of.licence", "of.cosine")

    tag = F.regexp_replace(F.regexp_extract("text", SPDX, 1), r"(?:-only|-or-later|\+)$", "")
    tagged = marked.select("path", tag.alias("tag")).where(F.col("tag") != "")
    tagged = tagged.select(
        "path", F.when(F.col("tag").isin(*TEMPLATES), F.col("tag")).otherwise(UNKNOWN).alias("licence"),
        F.when(F.col("tag").isin(*TEMPLATES), 1.0).alias("cosine"),
    )
    unknown = marked.where(F.col("text").rlike(DECLARES)).select(
        "path", F.lit(UNKNOWN).alias("licence"), F.lit(None).cast("double").alias("cosine")
    )
    ranked = [x.withColumn("rank", F.lit(k)) for k, x in enumerate((tagged, near, unknown))]
    best = F.min(F.struct("rank", "licence", "cosine")).alias("of")
    return ranked[0].union(ranked[1]).union(ranked[2]).groupBy("path").agg(best).select("path", "of.licence", "of.cosine")


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, with their depth; the root is the empty string."""
    parts = F.split(path, "/")
    depths = F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1))
    return F.transform(
        depths, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("directory"))
    )


def licences(
    files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = 0.8
) -> DataFrame:
    """Columns path, licence, cosine, inherited_from of every row of `files`.

    A file that declares a licence has it (inherited_from null), UNKNOWN where it is none of the templates, which
    files below a licence file of that kind then take. Any other takes that of the nearest
    directory above it that has a licence file (by name) declaring one; several in one directory: the
    highest cosine, then the name that sorts first. Without one all three are null. Directories are
    looked up by joins on the path of each ancestor; a path's own ancestors are one short list and
    directories are few beside files. Null paths and texts declare nothing and inherit nothing; rows
    that repeat a path stay. An empty table gives an empty result.
    """
    own = cut(declared(files, path_col, text_col, least))
    name = F.element_at(F.split("path", "/"), -1)
    holders = (
        own.where(name.rlike(LICENCE_FILE))
        .select(F.element_at(ancestors(F.col("path")), 1)["directory"].alias("directory"),
                F.struct((-F.coalesce("cosine", F.lit(0.0))).alias("less"), "licence").alias("of"))
        .groupBy("directory").agg(F.min("of").alias("of"))
    )
    rows = files.select(F.col(path_col).cast("string").alias("path"))
    unlicensed = rows.where("path is not null").distinct().join(own.select("path"), "path", "left_anti")
    above = unlicensed.select("path", F.inline(ancestors(F.col("path"))))
    taken = (
        above.join(written(holders), "directory")
        .groupBy("path").agg(F.max(F.struct("depth", "directory", "of")).alias("at"))
        .select("path", F.col("at.of.licence").alias("licence"), F.when(F.col("at.of.licence") != UNKNOWN, -F.col("at.of.less")).alias("cosine"),
                F.col("at.directory").alias("inherited_from"))
    )
    found = own.select("path", "licence", "cosine", F.lit(None).cast("string").alias("inherited_from")).union(taken)
    return rows.join(found, "path", "left")
