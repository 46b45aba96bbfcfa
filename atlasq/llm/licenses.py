"""Licences of documents: cosine of TF-IDF vectors to templates, and inheritance from the nearest directory above."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .store import materialize, small_batches, with_row_id

#: The notice of the GNU licences: what it is, the licence's first name, its version.
_GNU = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
#: Notices by which public licences are granted, titles and long forms of licence files.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3", _GNU.format("program", "", "3")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2", _GNU.format("program", "", "2")),
    "GPL": ("This work is licensed under the GNU General Public License.", "under the GNU General Public License", "Licensed under the GNU GPL."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3", _GNU.format("library", "Lesser ", "3")),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License Version 2.1", _GNU.format("library", "Lesser ", "2.1")),
    "LGPL-2.0": ("GNU Library General Public License Version 2", _GNU.format("library", "Library ", "2")),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License Version 3", _GNU.format("program", "Affero ", "3")),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
}
#: Terms that decide: of each group that a form has, a window must have one too. Versions are such terms.
DECIDING = [
    {"mit"}, {"isc"}, {"bsd"}, {"apache"}, {"mozilla"}, {"gnu", "gpl"}, {"lesser"}, {"library"}, {"affero"}, {"cc"}, {"by"}, {"by-nc"}, {"by-sa"},
    {"attribution"}, {"attribution-noncommercial"}, {"attribution-sharealike"}, {"2", "2.0"}, {"2.1"}, {"3", "3.0"}, {"4.0"}, {"redistribution", "redistributions"}, {"permission"}, {"fee"}, {"charge"},
]
#: "library" decides only where it is part of the licence's name.
NO_NEED = {("LGPL-3.0", "library"), ("LGPL-2.1", "library")}
#: Terms that a window of these licences must not have, and terms that must not stand within NEAR terms of it either.
BARRED = {"GPL-3.0": {"lesser", "affero"}, "GPL-2.0": {"lesser", "affero"}, "GPL": {"lesser", "affero", "library"}}
BARRED_NEAR = {"GPL": {"1", "1.0", "2", "2.0", "2.1", "3", "3.0"}}
NEAR = 12
#: A place is looked at if it has one of these, also across line breaks and comment signs.
MARKS = re.compile(r"licen[cs]e|permission\W+is\W+hereby|permission\W+to\W+use|redistribution\W+and\W+use|free\W+software|public\W+license|creative\W+commons|gpl", re.IGNORECASE)
LEAST = 0.7
#: Window starts compared at once.
STARTS = 1024
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*")
_BLANK = re.compile(r"\S[^\n]*\n[^\w\n]*\n")


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def vocabulary() -> list[str]:
    decisive = set().union(*DECIDING, *BARRED.values(), *BARRED_NEAR.values())
    return sorted({t for forms in TEMPLATES.values() for form in forms for t in terms(form)} | decisive)


#: Terms of the longest form.
LONGEST = max(len(terms(form)) for forms in TEMPLATES.values() for form in forms)


def notices(text: str, file: bool = False) -> list[tuple[bool, str]]:
    """The parts of a whole text that may state a licence, as terms with one space between.

    Whole ones (True): the header, which ends at the first blank line (or line of signs), and all of
    a licence file. Others (False): the terms around each mark, as many as the longest form has to either
    side and across line breaks; what overlaps is one part, and a long one is cut so that each window is in one.
    """
    if not MARKS.search(text):
        return []
    text = text.lower()
    marks = [m.start() for m in MARKS.finditer(text)]
    found = [(m.start(), m.group()) for m in _WORD.finditer(text)]
    at, words = np.array([a for a, _ in found]), [w for _, w in found]
    blank = _BLANK.search(text)
    header = blank.end() if blank else len(text)
    out = []
    if marks[0] < header:
        out.append((True, " ".join(words[: int(np.searchsorted(at, header))])))
    if file:
        out.append((True, " ".join(words)))
    spans: list[list[int]] = []
    for i in np.unique(np.searchsorted(at, marks, side="right") - 1).tolist():
        low, high = max(0, i - LONGEST), min(len(words), i + LONGEST + NEAR)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    for low, high in spans:
        for i in range(low, high, STARTS):
            # NEAR terms before, so that the first window's surroundings are seen
            out.append((False, " ".join(words[max(low, i - NEAR) : min(high, i + STARTS + LONGEST + NEAR)])))
            if i + STARTS + LONGEST + NEAR >= high:
                break
    return out


class Templates:
    """The forms as unit vectors over the vocabulary, weighted by idf, with their deciding terms."""

    def __init__(self, df: np.ndarray) -> None:
        words = vocabulary()
        self.number = {w: i for i, w in enumerate(words)}
        self.forms = [(name, terms(form)) for name, all_forms in TEMPLATES.items() for form in all_forms]
        # a term of every template says less than one of few; both the corpus and the templates count
        spread = np.array([max(1, sum(w in t for _, t in self.forms)) for w in words]) / len(self.forms)
        self.idf = np.append(1 + np.log(1 / spread) + 0.1 * np.log((1 + df[-1]) / (1 + df[:-1])), 1 + np.log(len(self.forms)))
        self.grid = np.zeros((len(self.forms), len(words)))
        for j, (_, own) in enumerate(self.forms):
            self.grid[j] = np.bincount(self.numbers(own), minlength=len(words)) * self.idf[:-1]
        self.grid /= np.linalg.norm(self.grid, axis=1, keepdims=True)
        columns = lambda group: [self.number[t] for t in sorted(group)]
        self.needs = [[columns(g) for g in DECIDING if g & set(own) and not any((name, t) in NO_NEED for t in g)] for name, own in self.forms]
        self.barred = [columns(BARRED.get(name, ())) for name, _ in self.forms]
        self.barred_near = [columns(BARRED_NEAR.get(name, ())) for name, _ in self.forms]
        self.by_length: dict[int, list[int]] = {}
        for j, (_, own) in enumerate(self.forms):
            self.by_length.setdefault(len(own), []).append(j)

    def numbers(self, own: list[str]) -> np.ndarray:
        return np.array([self.number.get(t, len(self.number)) for t in own], np.int64)

    def best(self, own: list[str], whole: bool) -> tuple[float, str | None]:
        """The highest cosine of any window (all terms, if whole) with a form whose deciding terms it has, and the form's licence."""
        v = len(self.number)
        if whole:
            n, counts = 1, np.stack([np.zeros(v + 1), np.bincount(self.numbers(own), minlength=v + 1)])
        else:
            n = len(own)
            counts = np.zeros((n + 1, v + 1), np.float32)
            counts[np.arange(1, n + 1), self.numbers(own)] = 1
            np.cumsum(counts, axis=0, out=counts)
        top: tuple[float, str | None] = (0.0, None)
        for size, forms in [(n, range(len(self.forms)))] if whole else self.by_length.items():
            size = min(size, n)
            low = np.arange(n - size + 1)
            c = counts[low + size] - counts[low]
            norm = np.sqrt((c[:, :-1] ** 2) @ self.idf[:-1] ** 2 + c[:, -1] * self.idf[-1] ** 2)
            near = counts[np.minimum(low + size + NEAR, n)] - counts[np.maximum(low - NEAR, 0)]
            for j in forms:
                s = (c[:, :-1] @ (self.grid[j] * self.idf[:-1])) / np.maximum(norm, 1e-9)
                for group in self.needs[j]:
                    s[c[:, group].sum(1) == 0] = 0
                if self.barred[j]:
                    s[c[:, self.barred[j]].sum(1) > 0] = 0
                if self.barred_near[j]:
                    s[near[:, self.barred_near[j]].sum(1) > 0] = 0
                top = min(top, (round(float(s.max()), 6), self.forms[j][0]), key=lambda x: (-x[0], x[1] or "~"))
        return top


def detected(docs: DataFrame, file: Column | None = None) -> DataFrame:
    """docs (which has none of the names used here) without text, with _license (null if none) and _similarity (0 if none).

    A document has the licence of the template with the highest cosine to its header, to the whole of it
    where file is true, or to a window of the template's length near a mark. Terms outside
    the templates count towards a window's length like those that only one template has. A term's
    document frequency counts the parts of all documents that notices() finds.
    """
    small_batches(docs.sparkSession)
    words = vocabulary()
    number = {w: i for i, w in enumerate(words)}
    others = [c for c in docs.columns if c != "text"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, whole, part = [], [], [], []
            for r, (text, is_file) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_file").to_pylist())):
                # a row without any notice has one row too, so that this one job reads the texts and numbers the rows
                for i, (w, x) in enumerate(notices(text or "", is_file) or [(None, None)]):
                    row.append(r)
                    first.append(i == 0)
                    whole.append(w)
                    part.append(x)
            own = batch.select([*others, "_rid"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(first, pa.bool_()), pa.array(whole, pa.bool_()), pa.array(part, pa.string())], [*others, "_rid", "_first", "_whole", "_part"])

    is_file = F.lit(False) if file is None else F.coalesce(file, F.lit(False))
    rows = with_row_id(docs.select(*others, F.col("text").cast("string").alias("text"), is_file.alias("_file")))
    schema = T.StructType([*(docs.schema[c] for c in others), *(T.StructField(n, t) for n, t in (("_rid", T.LongType()), ("_first", T.BooleanType()), ("_whole", T.BooleanType()), ("_part", T.StringType())))])
    table = materialize(rows.mapInArrow(parts, schema), "notices")
    found = table.where("_part is not null").select("_rid", F.col("_whole").alias("whole"), F.col("_part").alias("part"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for part in batch.column("part").to_pylist():
                total[[number[t] for t in set(part.split(" ")) if t in number]] += 1
                total[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "n"])

    df = np.zeros(len(words) + 1)
    for r in found.mapInArrow(frequencies, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r["i"]] = r["n"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.one_thread()
        templates = Templates(df)
        for batch in batches:
            best = [templates.best(x.split(" "), w) for w, x in zip(batch.column("whole").to_pylist(), batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_rid"), pa.array([s for s, _ in best], pa.float64()), pa.array([x for _, x in best], pa.string())], ["_rid", "similarity", "license"])

    best = found.mapInArrow(compare, "_rid long, similarity double, license string").where(f"similarity >= {LEAST}")
    best = best.groupBy("_rid").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "license")).alias("best"))
    out = table.where("_first").join(best, "_rid", "left")
    return out.select(*others, F.col("best.license").alias("_license"), F.coalesce(-F.col("best.less"), F.lit(0.0)).alias("_similarity"))


def licenses(docs: DataFrame, file_name: str = "LICENSE") -> DataFrame:
    """doc_id, path, own_license, similarity, license, inherited_from for each row of docs (doc_id, path, text).

    A document without a licence of its own has that of the licence file (a path ending in file_name
    with a licence of its own) in the nearest directory at or above its own; among several in one
    directory the most similar one, then the first by name, counts. Directories are joined, not
    documents: each distinct one with the ancestors that its path spells. Null or empty texts have no
    licence of their own; very long ones are scanned as a whole, around every mark. Forms that are equally
    similar to a text count by name as well. A null path has no directory. Repeated rows are documents of
    their own; other columns play no part. An empty table gives an empty result.
    """
    is_file = F.element_at(F.split("path", "/"), -1) == file_name
    found = materialize(detected(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text"), is_file), "licenses")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    found = found.withColumn("folder", folder)
    files = found.where(F.col("_license").isNotNull() & is_file)
    files = files.groupBy(F.col("folder").alias("above")).agg(F.min_by("_license", F.struct(-F.col("_similarity"), "_license")).alias("from_file"))
    folders = found.select("folder").where("folder is not null").distinct()
    parts = F.split("folder", "/")
    climbs = folders.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = climbs.join(files, "above").groupBy("folder").agg(F.max_by(F.struct("above", "from_file"), "depth").alias("near"))
    out = found.join(nearest, "folder", "left")
    own = F.col("_license")
    return out.select("doc_id", "path", own.alias("own_license"), F.col("_similarity").alias("similarity"), F.coalesce(own, F.col("near.from_file")).alias("license"), F.when(own.isNull(), F.col("near.above")).alias("inherited_from"))
