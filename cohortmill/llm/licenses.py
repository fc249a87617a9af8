"""License scans of a tree of files.

A file's header lines that speak of licences become sparse TF-IDF vectors over words, as do the templates of notices; the whole text of
a file that has such lines does too, beside whole licences. A file takes the template of the largest cosine if it reaches a threshold, ties to the
smaller name. A file whose text is mostly such lines, or that is named like one, declares its licence for its directory.
Files without a licence of their own inherit from the nearest ancestor directory that declares one,
found by joining the rows of their ancestors with the directories' declarations; only paths that need it are joined.

Weights of words come from the templates, a fixed vocabulary. Scoring is one pass without a
shuffle; declarations are aggregated first, so that a directory with a third of all files adds
one row for each task. Null text has no words. A null path has no directory and inherits nothing. Several
licences declared for a directory: the one of most files, then of the largest cosine, then the smaller name. Rows that repeat are scanned
row by row; extra columns are not read. Very long texts are scanned whole. Ties of cosines go to the smaller name. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

# Templates of licence headers, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3. Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0. Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following two conditions are met. Use of this source code is governed by a BSD 2-Clause license.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse. Use of this source code is governed by a BSD-style 3-Clause license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright to this work. CC0 1.0 Universal Public Domain Dedication.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2. This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3. This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3. Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction. Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Released under the Unlicense.",
}
# Whole licence texts.
BODIES = {
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
BODIES["BSD-3-Clause"] = BODIES["BSD-2-Clause"].replace("provided with the distribution. ", "provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")
_CUE = re.compile(r"licen[cs]|copyright|spdx|redistribut|permission is hereby|public domain|\bGPL\b|creative commons", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_FILE_NAMES = re.compile(r"(?:^|/)(?:licen[cs]e|copying|notice|unlicense)(?:[.-][^/]*)?$", re.IGNORECASE)
#: Cosine for a match; share of a text's characters on licence lines from which it counts as a licence file; cosine of a whole text to a whole licence from which it is one.
THRESHOLD, MOSTLY, WHOLE = 0.35, 0.5, 0.75


def _words(text: str) -> Counter:
    w = _WORD.findall(text.lower())
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


class Scanner:
    def __init__(self, templates: dict[str, str], bodies: dict[str, str]):
        # Each sentence of a template stands for itself, so that a one-line notice can match it whole.
        self.parts = [(name, _words(s)) for name in sorted(templates) for s in [templates[name], *re.split(r"(?<=[a-z0-9])\. ", templates[name])] if s]
        self.whole_from = len(self.parts)
        self.parts += [(name, _words(bodies[name])) for name in sorted(bodies)]
        df = Counter(w for _, words in self.parts for w in words)
        self.idf = {w: math.log((1 + len(self.parts)) / (1 + n)) + 1 for w, n in df.items()}
        self.unseen = math.log(1 + len(self.parts)) + 1
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for i, (_, words) in enumerate(self.parts):
            v = {w: (1 + math.log(n)) * self.idf[w] for w, n in words.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for w, x in v.items():
                self.by_word.setdefault(w, []).append((i, x / norm))

    def best(self, text: str, whole: bool = False) -> tuple[str | None, float]:
        """The nearest template and its cosine; with ``whole``, the nearest whole licence."""
        words = _words(text)
        if not words:
            return None, 0.0
        v = {w: (1 + math.log(n)) * self.idf.get(w, self.unseen) for w, n in words.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        dots: Counter = Counter()
        for w, x in v.items():
            for i, y in self.by_word.get(w, ()):
                if i >= self.whole_from or not whole:
                    dots[i] += x * y / norm
        if not dots:
            return None, 0.0
        i = min(dots, key=lambda k: (-round(dots[k], 12), self.parts[k][0]))
        return self.parts[i][0], round(dots[i], 12)

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """(licence or None, cosine, share of the text on licence lines): the best of its lines and runs of lines."""
        if not _CUE.search(text):
            return None, 0.0, 0.0
        lines = text.split("\n")
        marked = [bool(_CUE.search(x)) for x in lines]
        runs, at = [], 0
        while at < len(lines):
            if marked[at]:
                to = at
                while to + 1 < len(lines) and marked[to + 1]:
                    to += 1
                runs.append("\n".join(lines[at : to + 1]))
                runs += lines[at : to + 1] if to > at else []
                at = to
            at += 1
        share = sum(len(x) for x, m in zip(lines, marked, strict=True) if m) / max(1, len(text))
        found = [self.best(r) for r in runs]
        name, cosine = min(found, key=lambda f: (-f[1], f[0] or ""))
        body, near = self.best(text, whole=True)
        if near >= WHOLE:  # the lines of a wrapped licence speak of licences now and then only
            return body, near, 1.0
        return (name if cosine >= THRESHOLD else None), cosine, share


def scan(files: DataFrame, templates: dict[str, str] | None = None, bodies: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, path, text) -> doc_id, path, own string, cosine double, declares boolean."""
    shared = files.sparkSession.sparkContext.broadcast((templates or TEMPLATES, BODIES if bodies is None else bodies))

    def run(batches):
        s = Scanner(*shared.value)
        for batch in batches:
            paths = batch.column(1).to_pylist()
            found = [s.scan(t or "") for t in batch.column(2).to_pylist()]
            declares = [bool(f[0]) and (f[2] >= MOSTLY or bool(_FILE_NAMES.search(p or ""))) for f, p in zip(found, paths, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(declares)], names=["doc_id", "path", "own", "cosine", "declares"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text").mapInArrow(run, "doc_id long, path string, own string, cosine double, declares boolean")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds inherited string and from_dir string: the licence of the nearest ancestor directory that declares one."""
    declared = scanned.where("declares and path is not null").withColumn("dir", directory(F.col("path")))
    counts = declared.groupBy("dir", "own").agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine"))
    of = counts.groupBy("dir").agg(F.min_by("own", F.struct(-F.col("n"), -F.col("cosine"), "own")).alias("inherited"))
    # Distinct directories, not files, are joined with their ancestors.
    dirs = scanned.where("own is null and path is not null").select(directory(F.col("path")).alias("of")).distinct()
    parts = F.split("of", "/")
    above = dirs.select("of", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("dir"))
    nearest = above.join(of, "dir").groupBy("of").agg(F.max_by(F.struct("inherited", F.col("dir").alias("from_dir")), F.length("dir")).alias("near"))
    # Files with a licence, and those without a path, need no join.
    found = scanned.where("own is null and path is not null").withColumn("of", directory(F.col("path"))).join(nearest, "of", "left")
    found = found.select("doc_id", "path", "own", "cosine", "declares", F.col("near.inherited").alias("inherited"), F.col("near.from_dir").alias("from_dir"))
    rest = scanned.where("own is not null or path is null").withColumns({"inherited": F.lit(None).cast("string"), "from_dir": F.lit(None).cast("string")})
    return found.unionByName(rest)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited. Documents lie in <source>/<hundreds>/<id> of a tree."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    # Texts are scanned once; what the joins read are small rows.
    out = inherit(materialise(scan(docs.select("doc_id", path.alias("path"), "text")), "scanned"))
    return out.withColumn("license", F.coalesce("own", "inherited"))
