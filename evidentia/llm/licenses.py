"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along paths.

Every line of a file, every run of words as long as a template, and the file as a
whole, is a vector over words; weights come from the document frequencies of the
templates' words in the whole corpus.  Words that tell variants and versions of a
licence apart must agree besides.
A file without a licence of its own takes that of the nearest directory above it
that has a licence file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import by_size, cut, small_batches, stored, texts_of

#: Licence names, and notices or whole texts as they are published (fixed values).
_GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License"
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0",
)
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("BSD", _BSD),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    # headings of full texts
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    # whole notices and texts: of several that fit, the longest decides
    ("GPL-2.0", _GPL.format(";", "", ";", "2")),
    ("GPL-3.0", _GPL.format(":", "", ",", "3")),
    ("AGPL-3.0", _GPL.format(":", "Affero ", ",", "3")),
    ("LGPL-2.1", _GPL.replace("program", "library").format(";", "Lesser ", ";", "2.1")),
    ("LGPL-3.0", _GPL.replace("program", "library").format(":", "Lesser ", ",", "3")),
    ("MIT", f"{_MIT} {_NO_WARRANTY}"),
    ("ISC", _ISC),
    ("ISC", f"{_ISC} {_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD}: {_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}: {_BSD_2} {_BSD_3} {_BSD_END}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    # the name twice, so that it decides
    *((name, f"SPDX-License-Identifier: {name} {name}") for name in _SPDX),
)
#: Base names of licence files.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
#: What a line that speaks of a licence has.
SPEAKS = r"(?i)\blicen[cs]ed?\b|permission is hereby granted|permission to use, copy|redistribution and use in source|to the public domain|into the public domain|provided 'as-is', without any"
LEAST = 0.75
#: By a word of a template, the words that tell the licences of its family apart: a run of text must have the same of them.
FAMILIES = {"cc": frozenset(("by", "nc", "nd", "sa")), "gnu": frozenset(("lesser", "affero")), "gpl": frozenset(("lesser", "affero"))}
#: After these a number is a version: a template that names versions fits only where the text names the same.
VERSION_OF = frozenset(("version", "v", "gpl", "lgpl", "agpl", "mpl", "epl", "bsl", "bsd", "apache", "license", "by", "nc", "nd", "sa", "cc0"))
#: Words after a run that may still name its version.
AFTER = 2
_NUMBER = re.compile(r"\d+(?:\.\d+)*")
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.I)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def versions(found: list[str]) -> dict[int, str]:
    """Where words name a version, and which, without .0 at the end."""
    return {i: found[i].removesuffix(".0") for i in range(1, len(found)) if found[i][0].isdigit() and found[i - 1] in VERSION_OF and _NUMBER.fullmatch(found[i])}


VOCABULARY = frozenset(w for _, t in TEMPLATES for w in words(t))


class Model:
    """Weights of words, and the templates as unit vectors."""

    def __init__(self, frequency: dict[str, int], n_docs: int, least: float = LEAST) -> None:
        self.least, self.other = least, log(n_docs + 1) + 1  # of a word that no template has
        self.weight = {w: log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1 for w in VOCABULARY}
        self.templates = []
        for name, text in TEMPLATES:
            vector = {w: n * self.weight[w] for w, n in Counter(words(text)).items()}
            norm = sqrt(sum(x * x for x in vector.values()))
            self.templates.append((name, {w: x / norm for w, x in vector.items()}))
        self.size = [len(words(text)) - (len(words(name)) if text.startswith("SPDX") else 0) for name, text in TEMPLATES]  # as long as what it is compared with
        self.number = {w: i for i, w in enumerate(sorted(VOCABULARY))}
        self.square = np.array([self.weight[w] ** 2 for w in self.number] + [self.other**2])
        self.gain = np.array([[t.get(w, 0.0) * self.weight[w] for w in self.number] + [0.0] for _, t in self.templates])
        listed = [words(text) for _, text in TEMPLATES]
        self.kinds = [(family := frozenset().union(*(f for w, f in FAMILIES.items() if w in t)), family.intersection(t), frozenset(versions(t).values())) for t in listed]
        # words so common that they alone cannot reach `least` with any template: lines with no other need no product
        self.common: set[str] = set()
        for w in sorted(VOCABULARY, key=lambda x: (self.weight[x], x)):
            if max(sqrt(sum(x * x for v, x in t.items() if v == w or v in self.common)) for _, t in self.templates) >= least:
                break
            self.common.add(w)
        self.telling = VOCABULARY - self.common

    def closest(self, text: str) -> tuple[float, int, int, bool] | None:
        """(cosine, template, start, whole) of the closest template to the text as a whole, a line, or a run of words as long as it.

        Of equal cosines the longest template counts, then the first.  start is where
        the line, or that in which the run begins, begins; whole says that the text as
        a whole reaches `least`.  A template that names another variant or version
        than the run does not count.
        """
        lines = text.split("\n")
        found = [words(line) for line in lines]
        flat = [w for line in found for w in line]
        if self.telling.isdisjoint(flat):
            return None
        run = Runs(flat, self)
        sizes = np.array([len(x) for x in found])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        own, limit = begins[sizes > 0], ends[sizes > 0]
        apart = run.norms(own, limit)
        every, to = np.array([0]), np.array([len(flat)])
        all_of = run.norms(every, to)
        best: tuple[float, int, int, int] | None = None
        whole = False
        for k, size in enumerate(self.size):
            gains = np.r_[0.0, np.cumsum(self.gain[k][run.known])]
            parts = [(every, to, all_of), (own, limit, apart)]
            starts = np.arange(max(0, len(flat) - size + 1))
            # repeated words counted apart make a norm too small, so this bounds the cosines of all runs
            if (np.square(gains[starts + size] - gains[starts]) >= (self.least - 1e-9) ** 2 * (run.squares[starts + size] - run.squares[starts])).any():
                parts.append((starts, starts + size, run.sliding(size)))
            for n, (start, end, norm) in enumerate(parts):
                cosine = np.round((gains[end] - gains[start]) / norm, 9)
                fit = np.flatnonzero(cosine >= self.least)
                fit = fit[run.fits(self.kinds[k], start[fit], end[fit])]
                if not len(fit):
                    continue
                whole |= n == 0
                at = fit[np.argmax(cosine[fit])]
                if best is None or (cosine[at], size) > (best[0], best[1]):
                    best = (float(cosine[at]), size, k, int(start[at]))
        if best is None:
            return None
        line = int(np.searchsorted(ends, best[3], "right"))
        return best[0], best[2], sum(len(x) + 1 for x in lines[:line]), whole

    def name(self, template: int, text: str, start: int) -> str:
        """What is found there: the template's licence, or of an SPDX expression all licences that are known, with what joins them."""
        told = _EXPRESSION.search(text, start) if TEMPLATES[template][1].startswith("SPDX") else None
        if told is None:
            return self.templates[template][0]
        parts = re.split(r"\s+(OR|AND)\s+", told[1].replace("(", " ").replace(")", " ").strip(), flags=re.I)
        ids = [re.sub(r"(-only|-or-later|\+)$", "", (x.split() or [""])[0], flags=re.I) for x in parts[::2]]
        known = {x.lower(): x for x in _SPDX}
        out = ""
        for x, joint in zip(ids, ["", *parts[1::2]], strict=True):
            if x.lower() in known:
                out += (f" {joint.upper()} " if out else "") + known[x.lower()]
        return out or self.templates[template][0]


class Runs:
    """The words of one text, ready for sums over runs of them."""

    def __init__(self, flat: list[str], model: Model) -> None:
        number: dict[str, int] = {}
        self.word = np.array([number.setdefault(w, len(number)) for w in flat], dtype=np.int64)
        self.known = np.array([model.number.get(w, -1) for w in number], dtype=np.int64)[self.word]
        self.square = model.square[self.known]
        self.squares = np.r_[0.0, np.cumsum(self.square)]
        self.n = len(flat)
        self.sorted = np.sort(self.word * self.n + np.arange(self.n))
        self.version = versions(flat)
        self.variant = {w: np.r_[0, np.cumsum(self.word == number[w])] for f in FAMILIES.values() for w in f if w in number}

    def norms(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Norms of runs that do not overlap."""
        of = np.repeat(np.arange(len(start)), end - start)
        at = np.concatenate([np.arange(a, b) for a, b in zip(start, end, strict=True)]) if len(start) != 1 else np.arange(start[0], end[0])
        key, first, count = np.unique(of * self.n + self.word[at], return_index=True, return_counts=True)
        return np.sqrt(np.bincount(key // self.n, count**2 * self.square[at[first]], minlength=len(start)))

    def sliding(self, size: int) -> np.ndarray:
        """Norms of all runs of `size` words.

        A word that comes into a run that has it c times adds (2c + 1) of its square,
        one that goes takes as much away.
        """
        i = np.arange(self.n)
        upto = lambda at: np.searchsorted(self.sorted, self.word * self.n + at)
        here = upto(i)
        comes = here - upto(np.maximum(i - size + 1, 0))
        goes = upto(np.minimum(i + size, self.n)) - here - 1
        total = np.cumsum(self.square * (2 * comes + 1))[size - 1 :]
        gone = np.r_[0.0, np.cumsum(self.square * (2 * goes + 1))][: len(total)]
        return np.sqrt(total - gone)

    def fits(self, kind: tuple[frozenset[str], frozenset[str], frozenset[str]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which runs have the words of the family that the template has and no others, and name its versions and no others."""
        family, own, named = kind
        ok = np.ones(len(start), dtype=bool)
        for w in family:
            seen = self.variant.get(w)
            has = seen[end] > seen[start] if seen is not None else np.zeros(len(start), dtype=bool)
            ok &= has == (w in own)
        if named and ok.any():
            at = np.array(sorted(self.version), dtype=np.int64)
            said = [self.version[i] for i in at.tolist()]
            after = np.minimum(end + AFTER, self.n)
            for v in {*said, *named}:
                places = at[[x == v for x in said]] if said else at
                ok &= (np.searchsorted(places, after) > np.searchsorted(places, start)) == (v in named)
        return ok


def fit(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> Model:
    """Document frequencies of the templates' words over all of docs."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in by_size(batches, "t", 4 << 20):
            for text in texts_of(batch.column(0)):
                total[""] += 1
                total.update(VOCABULARY.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in rows.collect()}  # one row per word of the templates
    return Model(found, found.pop("", 0), least)


def match(docs: DataFrame, model: Model, id_col: str, path: Column, text_col: str) -> DataFrame:
    """(id, path, license, score, start, whole) per row of docs: its best line or passage, or itself as a whole."""
    small_batches(docs.sparkSession)
    fields = [("id", docs.schema[id_col].dataType), ("path", T.StringType()), ("license", T.StringType()), ("score", T.DoubleType()), ("start", T.LongType()), ("whole", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "t", 4 << 20):
            rows = []
            for text in texts_of(batch.column(2)):
                best = model.closest(text)
                rows.append((model.name(best[1], text, best[2]), best[0], best[2], best[3]) if best else (None, None, None, False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.int64(), pa.bool_()), strict=True))], [f[0] for f in fields])

    return docs.select(F.col(id_col).alias("id"), path.alias("p"), F.col(text_col).alias("t")).mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/?[^/]*$", "")


def inherit(files: DataFrame) -> DataFrame:
    """files (id, path, license, score, start, whole) with the folder's licence and what holds in the end.

    A folder's licence is that of its best licence file: a name like LICENSE, or a
    text that is a licence as a whole; ties go to the smallest path.
    """
    own = files.withColumn("folder", _folder(F.col("path")))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE)
    given = own.where(F.col("license").isNotNull() & F.col("path").isNotNull() & (named | F.col("whole"))).groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("x"))
    given = cut(given.select(F.col("folder").alias("above"), F.col("x.license").alias("inherited"), F.col("x.path").alias("from_path")))
    folders = own.where("path is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    near = folders.select("folder", F.inline(ancestors)).join(given, "above").groupBy("folder").agg(F.max_by(F.struct("inherited", "from_path"), "depth").alias("x"))
    near = cut(near.select(F.col("folder").alias("f"), "x.inherited", "x.from_path"))
    out = own.join(near, F.col("folder") == F.col("f"), "left")
    has = F.col("license").isNotNull()
    return out.select("id", "path", F.col("license").alias("own_license"), "score", "start", F.when(~has, F.col("inherited")).alias("inherited_license"), F.when(~has, F.col("from_path")).alias("inherited_from"), F.coalesce("license", "inherited").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", path: Column | str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, path, own_license, score, start, inherited_license, inherited_from, license) per row of docs.

    start is where the best line, or the line in which the best run of words
    begins, begins, in characters.  The time for a text is in proportion to its
    words, but for a logarithm, whatever they are.  An SPDX expression gives all of
    its licences that are known, as in "MIT OR Apache-2.0".  A null or empty text
    has no licence of its own; a null path inherits nothing; of the licence files of
    a folder with equal scores the one with the smallest path counts.  Ids may
    repeat or be null; other columns are ignored.
    """
    files = stored(match(docs, fit(docs, text_col, least), id_col, F.col(path) if isinstance(path, str) else path, text_col), "licences")
    return inherit(files).withColumnRenamed("id", id_col)


def made_up_path() -> Column:
    """A path for the rows of documents: source, language, one or two folders by a hash of the id, and the id as a name.

    A text whose first or last line speaks of a licence is called LICENSE and the
    id, and stands in one of the three folders above.  A null id, source or
    language counts as "none".
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    digest = F.xxhash64(part("doc_id"))
    folders = [part("source"), part("lang"), F.concat(F.lit("a"), F.pmod(digest, F.lit(16))), F.concat(F.lit("b"), F.pmod(F.shiftright(digest, 4), F.lit(8)))]
    edge = F.concat_ws("\n", F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1))
    depth = F.pmod(F.shiftright(digest, 8), F.lit(3)).cast("int") + 2
    notice = F.concat_ws("/", F.slice(F.array(*folders), F.lit(1), depth), F.concat(F.lit("LICENSE."), part("doc_id")))
    return F.when(edge.rlike(SPEAKS), notice).otherwise(F.concat_ws("/", *folders, F.concat(part("doc_id"), F.lit(".txt"))))
