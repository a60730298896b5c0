"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import small_side
from recollect.operators.staging import scope, stage

# Least cosine of a header, and of a file that speaks for its directory.
HEADER_COSINE = 0.6
FILE_COSINE = 0.8
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, "
)
_BSD = (
    "Copyright (c) Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Notices by which licences are declared, several wordings for some, and whole short licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, version 1.1."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("CC-BY-NC-3.0", "Licensed under CC BY-NC 3.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    # Whole texts.
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
            "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all copies "
            "or substantial portions of the Software. " + _AS_IS + "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
            "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
            "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
            "USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted, provided that the above copyright notice and this permission notice appear "
            "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
            "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
            "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
            "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
            "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission. "
                     + _BSD_END),
]
# Terms that tell licences and their versions apart: a notice is named only if the text has the same ones.
_MARKERS = frozenset(
    "mit apache gnu lesser affero mozilla bsd isc cc cc0 by sa nc nd clause 1 1.0 1.1 1.2 2 2.0 2.1 2.5 3 3.0 4 4.0".split()
)
# Templates longer than this are whole texts, in which numbers count clauses.
NOTICE_TERMS = 60
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_TERMS, _TERM_PLACES = _TERM.findall, _TERM.finditer


def _terms(text: str) -> list[str]:
    return _TERMS(text.lower())


def _vocabulary() -> frozenset[str]:
    return frozenset(term for _, text in TEMPLATES for term in _terms(text))


def term_weights(docs: DataFrame) -> tuple[dict[str, float], float]:
    """(weight of each template term, weight of any other term): inverse document frequencies.

    Counted over the whole texts of all rows; the result has one entry per template term, and
    other terms, which no template has, weigh like a term of one document.
    """
    vocabulary = _vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0):
                seen.update(vocabulary.intersection(_terms(text.as_py() or "")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "docs"]
            )

    counted = docs.select("text").mapInArrow(run, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))
    found = {row["term"]: row["docs"] for row in counted.collect()}
    rows = docs.count()
    weight = lambda n: math.log((1 + rows) / (1 + n)) + 1
    return {term: weight(found.get(term, 0)) for term in vocabulary}, weight(0)


class Scanner:
    """Cosines of texts to the templates, as sparse vectors of term count times weight."""

    def __init__(self, weights: Mapping[str, float], other: float):
        # Number 0 is every term outside the templates.
        self.number = {term: n for n, term in enumerate(sorted(weights), 1)}
        self.weight = np.array([other, *(weights[term] for term in self.number)])
        self.names, self.lengths, self.markers = [], [], []
        self.share = np.zeros((len(TEMPLATES), len(self.weight)))
        for n, (name, text) in enumerate(TEMPLATES):
            terms = _terms(text)
            for term, k in Counter(terms).items():
                self.share[n, self.number[term]] = k * weights[term]
            self.names.append(name)
            self.lengths.append(len(terms))
            self.markers.append(_MARKERS.intersection(terms) if len(terms) <= NOTICE_TERMS else None)
        self.share /= np.sqrt((self.share**2).sum(axis=1))[:, None]
        # What one occurrence of a term adds to the dot product with each template.
        self.gain = self.share * self.weight
        self.squares = self.share**2
        self.needed = np.zeros(self.share.shape, bool)
        for n, markers in enumerate(self.markers):
            self.needed[n, [self.number[term] for term in markers or ()]] = True

    def coded(self, terms: list[str]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(term, 0) for term in terms), np.int32, len(terms))

    def _reach(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each template the largest cosine that any of the terms can give, and whether all its markers are there."""
        there = np.zeros(len(self.weight), bool)
        there[codes] = True
        there[0] = False
        return np.sqrt(self.squares @ there), ~(self.needed & ~there).any(axis=1)

    def _fits(self, n: int, terms: list[str]) -> bool:
        """True if the markers among the terms are the template's."""
        return self.markers[n] is None or _MARKERS.intersection(terms) == self.markers[n]

    def _length(self, terms: list[str]) -> float:
        get = self.number.get
        return math.sqrt(sum((k * self.weight[get(term, 0)]) ** 2 for term, k in Counter(terms).items()))

    def best(self, terms: list[str], codes: np.ndarray) -> tuple[float, str | None]:
        """Largest cosine of the whole from FILE_COSINE and its licence, the first template on ties; else (0, None).

        A template whose markers aren't the text's is passed over.
        """
        reach, there = self._reach(codes)
        if not (there & (reach >= FILE_COSINE - 1e-9)).any():
            return 0.0, None
        dots = self.gain[:, codes].sum(axis=1) if len(codes) < 4096 else self.gain @ np.bincount(codes, minlength=len(self.weight))
        length = self._length(terms)
        for n in np.argsort(-dots, kind="stable"):
            if dots[n] > 0 and self._fits(n, terms):
                return float(min(1.0, dots[n] / length)), self.names[n]
        return 0.0, None

    def header(self, text: str, terms: list[str], codes: np.ndarray) -> tuple[float, str | None, int | None]:
        """Best window of a text: (cosine, licence, number from 1 of the line it begins in).

        For each template all windows of its number of terms are scored, over line feeds too; the
        first template and window count on ties. A window's dot product is a difference of running
        sums, and so is the least length it can have, when no term repeats; exact lengths are taken
        where the cosine could be the best. Whole licences come first and need FILE_COSINE, as licences
        share sentences that notices quote.
        """
        score, name, place, found = 0.0, None, None, 0
        reach, there = self._reach(codes)
        likely = there & (reach >= HEADER_COSINE - 1e-9)
        if not likely.any():
            return score, name, place
        weight = self.weight[codes]
        squares = np.concatenate([[0.0], np.cumsum(weight * weight)])
        for n in sorted(range(len(self.names)), key=lambda n: self.markers[n] is not None):
            if place is not None and self.markers[n] is not None and self.markers[found] is None:
                break
            if not likely[n]:
                continue
            least = FILE_COSINE if self.markers[n] is None else HEADER_COSINE
            m = min(self.lengths[n], len(codes))
            sums = np.concatenate([[0.0], np.cumsum(self.gain[n][codes])])
            bound = (sums[m:] - sums[:-m]) / np.sqrt(squares[m:] - squares[:-m])
            places = np.flatnonzero(bound >= least - 1e-9)
            for k in places[np.argsort(-bound[places], kind="stable")].tolist():
                if bound[k] <= score + 1e-9:
                    break
                window = terms[k:k + m]
                cosine = min(1.0, float(sums[k + m] - sums[k]) / self._length(window))
                if cosine > score + 1e-9 and cosine >= least and self._fits(n, window):
                    score, name, place, found = cosine, self.names[n], k, n
        if place is None:
            return 0.0, None, None
        begin = next(islice(_TERM_PLACES(text.lower()), place, None)).start()
        return score, name, text.lower().count("\n", 0, begin) + 1


def scan(files: DataFrame, weights: Mapping[str, float], other: float) -> DataFrame:
    """path, licence, score and line of the best header, and the same two for the whole file."""
    schema = "path string, licence string, score double, line int, file_licence string, file_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(weights, other)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                terms = _terms(text)
                codes = scanner.coded(terms)
                score, name, line = scanner.header(text, terms, codes)
                whole, whole_name = scanner.best(terms, codes)
                rows.append((name, score, line, whole_name, whole))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.string(), pa.float64(), pa.int32(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                names=["path", "licence", "score", "line", "file_licence", "file_score"],
            )

    return files.select("path", "text").mapInArrow(run, schema)


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, ending with the root ''."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def scan_licences(files: DataFrame) -> DataFrame:
    """Columns path, licence, score, line, declared_by for each row of ``files`` (path, text).

    A file's licence is the template nearest to a window of as many terms, anywhere in its text, if
    their TF-IDF cosine reaches HEADER_COSINE and names and versions agree. A file that as a whole reaches FILE_COSINE is a licence file and declares its
    directory; of several the best cosine counts, then the smaller path. A file without header
    inherits from the nearest directory above it that is declared; ``declared_by`` names the
    licence file, null for own headers and where there is none. Null and empty texts have no
    header; a null path inherits nothing. Repeated rows give repeated results.

    The path joins pair each file without header with the declared directories only: one row per
    directory, and as many lookups as the path is deep.
    """
    with scope() as keep:
        weights, other = term_weights(files)
        scanned = stage(scan(files, weights, other), "scanned")
        speaks = scanned.where((F.col("file_score") >= FILE_COSINE) & F.col("path").isNotNull())
        declared = stage(
            speaks.groupBy(F.element_at(ancestors(F.col("path")), 1).alias("folder")).agg(
                F.min(F.struct((-F.col("file_score")).alias("order"), "path", "file_licence")).alias("by"),
            ).select("folder", F.col("by.file_licence").alias("folder_licence"), F.col("by.path").alias("declared_by"), F.col("by.order").alias("order")),
            "declared",
        )
        bare = scanned.where(F.col("licence").isNull() & F.col("path").isNotNull()).select("path").distinct()
        above = bare.select("path", F.posexplode(ancestors(F.col("path"))).alias("steps", "folder"))
        nearest = above.join(small_side(declared, 512), "folder").groupBy("path").agg(
            F.min(F.struct("steps", "folder_licence", "declared_by", "order")).alias("near")
        )
        out = scanned.join(nearest, "path", "left").select(
            "path", F.coalesce("licence", "near.folder_licence").alias("licence"),
            F.when(F.col("licence").isNotNull(), F.col("score")).otherwise(F.coalesce(-F.col("near.order"), F.lit(0.0))).alias("score"),
            "line", F.when(F.col("licence").isNull(), F.col("near.declared_by")).alias("declared_by"),
        )
        return keep(out, "licences")


def document_licences(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, path, licence, score, line, declared_by.

    Documents lie at source/language/doc_id; a null part of the path is ``_``, so a null id too.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("_"))
    files = docs.select(F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")
    last = F.element_at(F.split("path", "/"), -1)
    return scan_licences(files).select(
        F.when(last != "_", last).cast("long").alias("doc_id"), "path", "licence", "score", "line", "declared_by"
    )
