"""License scans (2): sparse TF-IDF cosine to templates, then inheritance along directories.

1. Candidates of every file, whatever its name: each line, each two neighbouring lines, each header block
   (lines with terms up to one without, so comment marks do not matter), and the whole text. Weights of template
   terms are inverse document frequencies counted over all lines of all files and all templates. A candidate's
   cosine to a template is a sparse dot product over an inverted index; one that shares no term of
   the rarer kind cannot reach the threshold and is passed over.
2. A file's own licence is its best match. Among equal matches (licences that share a paragraph) the one with a
   template nearest to the whole text is taken, then one whose version number the text holds, then the first by name. Licence files (by base name) also speak for
   their directory: the best match of its licence files, ties to the smallest path.
3. A file without a licence of its own inherits from the nearest ancestor directory, its own first, by
   a path join: directories are exploded into their ancestors (a file's depth bounds the rows), joined
   to the licensed ones and reduced to the deepest match, once for each directory.

Defined edge cases: a null text has no lines; a null path has no directory and inherits nothing;
repeated rows are rows of their own; without any licence file nothing is inherited; an empty table gives
no rows; extra columns are ignored but for ``key``, which is passed on.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import cut, slices

LIST_MARK = re.compile(r"^\W*\d{1,2}[.)]\s+(?=\S)")
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

# Notices and headers of common licences, and the opening words of their texts.
_GNU = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "Licensed under the GNU Affero General Public License, version 3.",
        _GNU.format(":", "Affero ", "3"),
    ),
    "All-rights-reserved": ("All rights reserved.",),
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD_GRANT, f"{_BSD_GRANT} {_BSD_CLAUSES}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _BSD_GRANT, _BSD_NAME, f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_NAME}"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", "Creative Commons Legal Code CC0 1.0 Universal"),
    "EPL-2.0": (
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "GPL-2.0": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.",
        _GNU.format(";", "", "2"),
    ),
    "GPL-3.0": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3",
        _GNU.format(":", "", "3"),
    ),
    "ISC": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Licensed under the GNU Lesser General Public License, version 3.",
        _GNU.format(":", "Lesser ", "3"),
    ),
    "MIT": (
        "The MIT License (MIT)",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        _MIT_GRANT,
        f"{_MIT_GRANT} {_MIT_NOTICE} {_AS_IS}",
    ),
    "MPL-1.1": (
        "MOZILLA PUBLIC LICENSE Version 1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": (
        "zlib License",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ),
}


def with_tags(templates: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """The templates, each with the one-line tag that names it."""
    return {name: (*notices, f"SPDX-License-Identifier: {name}") for name, notices in templates.items()}


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def template_terms(templates: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({t for notices in templates.values() for notice in notices for t in terms(notice)})


class Matcher:
    """TF-IDF vectors of the templates under given term weights, and an inverted index of them."""

    def __init__(self, templates: dict[str, tuple[str, ...]], weights: dict[str, float], unknown: float, threshold: float):
        self.weights, self.unknown, self.threshold = weights, unknown, threshold
        self.vectors = [(name, self.vector(terms(notice))) for name, notices in sorted(templates.items()) for notice in notices]
        self.index: dict[str, list[tuple[int, float]]] = {}
        # Terms whose absence from a line rules every template out: for each template the rest of its
        # terms alone stays under the threshold.
        self.keys = set()
        for k, (_, vector) in enumerate(self.vectors):
            rest = 1.0
            for term, value in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                self.index.setdefault(term, []).append((k, value))
                if math.sqrt(max(rest, 0)) >= threshold - 1e-6:
                    self.keys.add(term)
                rest -= value * value

    def vector(self, found: list[str]) -> dict[str, float]:
        raw = {t: (1 + math.log(n)) * self.weights.get(t, self.unknown) for t, n in Counter(found).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()} if norm else {}

    def cosines(self, found: list[str]) -> dict[str, float]:
        """The best cosine of each licence that shares a term."""
        sums: dict[int, float] = {}
        for term, value in self.vector(found).items():
            for k, weight in self.index.get(term, ()):
                sums[k] = sums.get(k, 0.0) + value * weight
        best: dict[str, float] = {}
        for k, value in sums.items():
            name = self.vectors[k][0]
            best[name] = max(best.get(name, 0.0), round(value, 6))
        return best

    def scan(self, text: str | None) -> tuple[str | None, float | None, int | None]:
        """Licence, cosine and first line of a text's best candidate."""
        best: dict[str, tuple[float, int]] = {}  # of each licence at or above the threshold: cosine and line

        def rate(found: list[str], at: int) -> None:
            if not self.keys.isdisjoint(found):
                for name, score in self.cosines(found).items():
                    if score >= self.threshold and score > best.get(name, (0.0, 0))[0]:
                        best[name] = (score, at)

        whole: list[str] = []
        block: list[str] = []
        before: list[str] = []
        began = size = 0
        lines = text.split("\n") if text else []
        for n, line in enumerate(lines):
            found = terms(LIST_MARK.sub("", line))
            rate(found, n)
            if found and before:
                rate(before + found, n - 1)
            if found:
                began = began if block else n
                block += found
                size += 1
                whole += found
            if block and (not found or n == len(lines) - 1):
                if size > 2:
                    rate(block, began)
                block, size = [], 0
            before = found
        rate(whole, 0)
        if not best:
            return None, None, None
        top = max(score for score, _ in best.values())
        rivals = [name for name, (score, _) in best.items() if score == top]
        if len(rivals) > 1:
            numbers = {t for t in whole if t[0].isdigit()}
            as_whole = self.cosines(whole)
            rivals.sort(key=lambda name: (-as_whole.get(name, 0.0), not numbers.intersection(terms(name.replace("-", " "))), name))
        name = rivals[0]
        return name, best[name][0], best[name][1]


def term_weights(files: DataFrame, templates: dict[str, tuple[str, ...]]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the template terms over all lines, and that of unseen terms."""
    wanted = frozenset(template_terms(templates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for line in text.split("\n") if text else ():
                    total.update(wanted.intersection(terms(line)))
                    total[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    rows = files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a template term
    seen = {r["term"]: r["n"] for r in rows}
    lines = seen.get("", 0) + 1  # the templates count as one line, so that their number does not make their words common
    weigh = lambda n: math.log((1 + lines) / (1 + n)) + 1
    return {t: weigh(seen.get(t, 0) + 1) for t in wanted}, weigh(1)


def directory(path: Column) -> Column:
    """The part before the last slash; empty for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = 0.6, license_file: str = LICENSE_FILE) -> DataFrame:
    """path, own_license, cosine, line, license (own or inherited), inherited_from (a path, or null),
    one row for each row of (path, text); ``key`` (if there) is passed on."""
    spark = files.sparkSession
    keep = [F.col("key")] if "key" in files.columns else []
    base = files.select(*keep, F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    known = with_tags(templates or TEMPLATES)
    shared = spark.sparkContext.broadcast((known, *term_weights(base, known), threshold))
    carried = [f.name for f in base.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value)
        for batch in slices(batches):
            found = [matcher.scan(x) for x in batch.column("text").to_pylist()]
            names, scores, places = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(places, pa.int64())], [*carried, "own_license", "cosine", "line"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    scanned = cut(base.mapInArrow(run, f"{kinds}, own_license string, cosine double, line long").withColumn("dir", directory(F.col("path"))), "licenses")

    speaks = scanned.where(F.col("own_license").isNotNull() & F.regexp_replace("path", r"^.*/", "").rlike(license_file))
    licensed = speaks.groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), "path", "own_license")).alias("best")).select(F.col("dir").alias("above"), F.col("best.path").alias("from_path"), F.col("best.own_license").alias("from_license"))
    folders = scanned.select("dir").where("dir is not null").distinct()
    ancestors = folders.select("dir", F.explode(F.expr("transform(sequence(0, size(split(dir, '/'))), n -> array_join(slice(split(dir, '/'), 1, n), '/'))")).alias("above")).distinct()
    nearest = ancestors.join(licensed, "above").groupBy(F.col("dir").alias("folder")).agg(F.max(F.struct(F.length("above"), "above", "from_path", "from_license")).alias("hit"))
    joined = scanned.join(nearest, scanned["dir"] == nearest["folder"], "left")
    inherits = F.col("own_license").isNull()
    return joined.select(
        *carried, "own_license", "cosine", "line",
        F.coalesce("own_license", "hit.from_license").alias("license"),
        F.when(inherits, F.col("hit.from_path")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """(key, path, text): documents as files of a tree source/lang/shard. Every 50th id of a source's
    shard is that folder's LICENSE file, every 1000th that of the whole source."""
    shard = F.pmod(F.floor(F.col("doc_id") / 50), F.lit(20)).cast("string")
    folder = F.when(F.col("doc_id") % 1000 == 0, F.coalesce("source", F.lit("-"))).otherwise(F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), shard))
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(F.concat(F.lit("doc-"), "doc_id"))
    return docs.select(F.col("doc_id").cast("long").alias("key"), F.concat_ws("/", folder, F.concat(name, F.lit(".txt"))).alias("path"), "text")
