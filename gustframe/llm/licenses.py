"""License scans: sparse TF-IDF cosine of header lines, header blocks (adjacent lines) and whole files to licence
templates, then inheritance from the nearest ancestor directory with a licence file.

Terms are the words of the templates; every other word of a line or file counts as a term that no
text has (so with the largest weight), which keeps a mention inside prose apart from a notice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustframe.llm.common import byte_slices, prepare, stored, utf8
from gustframe.llm.wordhash import ASCII_NO_WORD, WordHasher

# The notices by which a text states its licence.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright to this work (CC0 1.0).",
                "This work is in the public domain."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "SPDX-License-Identifier: GPL-3.0-or-later"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.",),
}
FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
OLD_FREE = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
GNU = {"GPL-2.0": ("General Public License", "2", "June 1991"), "GPL-3.0": ("General Public License", "3", "29 June 2007"),
       "LGPL-2.1": ("Lesser General Public License", "2.1", "February 1999"),
       "LGPL-3.0": ("Lesser General Public License", "3", "29 June 2007"),
       "AGPL-3.0": ("Affero General Public License", "3", "19 November 2007")}
REDISTRIBUTION = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                  "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                  "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                  "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
# Standard titles, notices and header blocks of the common licences.
HEADERS = {
    **{name: (f"This work is licensed under the GNU {title}, version {version}.", f"Licensed under the GNU {title}, version {version}.",
              f"GNU {title} Version {version}", f"GNU {title} Version {version}, {date}", f"GNU {title} v{version}", f"Licensed under the {name}.",
              f"SPDX-License-Identifier: {name}", f"SPDX-License-Identifier: {name}-only", f"SPDX-License-Identifier: {name}-or-later",
              FREE.format(title, version), OLD_FREE.format(title, version)) for name, (title, version, date) in GNU.items()},
    "Apache-2.0": ("Apache License", "Apache License Version 2.0, January 2004", "Licensed under the Apache License 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT": ("MIT License", "The MIT License (MIT)",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions:"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", REDISTRIBUTION),
    "BSD-3-Clause": ("BSD 3-Clause License",
                     f"{REDISTRIBUTION} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    "ISC": ("ISC License", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    "0BSD": ("BSD Zero Clause License", "SPDX-License-Identifier: 0BSD"),
    "MPL-2.0": ("Mozilla Public License Version 2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "EPL-1.0": ("Eclipse Public License - v 1.0", "SPDX-License-Identifier: EPL-1.0",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
                "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "EPL-2.0": ("Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
                "is available at https://www.eclipse.org/legal/epl-2.0/"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0",
                "Distributed under the Boost Software License, Version 1.0."),
    "Unlicense": ("SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain."),
    "CC0-1.0": ("CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
}
TEMPLATES = {name: (*TEMPLATES.get(name, ()), *HEADERS.get(name, ())) for name in [*TEMPLATES, *(n for n in HEADERS if n not in TEMPLATES)]}
HEADER_COSINE, FILE_COSINE = 0.75, 0.5
#: A licence's own text has to come this near: a whole text shares its common words with any long prose.
BODY_COSINE = 0.8
#: Words and numbers of a notice that the line must have too, and words that make another licence of it.
NAMES = ("agpl affero apache attribution boost bsd bsl cc cc0 0bsd creative eclipse epl gnu gpl isc lgpl lesser mit mozilla mpl neither "
         "noncommercial nc provided unencumbered unlicense zero v1 v2 v3").split()
OTHERS = "affero agpl lesser lgpl library nc nd neither noderivatives noncommercial sa sharealike".split()
#: A block is scored only if one of its lines has one of these words.
MARKS = "copy copyright distributed free granted license licensed licence permission redistribution redistributions subject terms".split()
BLOCK_LINES = 16
#: Rows of one dense piece of the cosines.
ROWS = 1000
SLICE = 4 << 20


def bodies() -> dict[str, tuple[str, ...]]:
    """Whole licence texts. The text of AGPL-3.0 is that of GPL-3.0 with its name."""
    texts = {f.name.removesuffix(".txt"): (f.read_text(),) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    gpl = texts["GPL-3.0"][0]
    return texts | {"AGPL-3.0": (gpl.replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL"),)}


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(WordHasher(ASCII_NO_WORD).words([" ".join(words).encode()])[0])


@dataclass(frozen=True)
class Scorer:
    """Templates as unit vectors over ``terms`` (sorted word hashes)."""

    names: tuple[str, ...]
    terms: np.ndarray
    weights: np.ndarray       # idf of each term, and last of a word that is no term
    vectors: np.ndarray       # (template, term)
    needed: np.ndarray        # (template, term) 1 where the unit must have the term
    barred: np.ndarray        # (template, term) 1 where it must not

    @staticmethod
    def terms_of(templates: dict) -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
        names = tuple(name for name, texts in templates.items() for _ in texts)
        words, counts = WordHasher(ASCII_NO_WORD).words([t.encode() for texts in templates.values() for t in texts])
        terms = np.union1d(words, _hashes(OTHERS))
        tf = np.zeros((len(names), len(terms)))
        np.add.at(tf, (np.repeat(np.arange(len(names)), counts), np.searchsorted(terms, words)), 1)
        return names, terms, tf

    @classmethod
    def of(cls, templates: dict, texts_with: dict[int, int], texts: int, guarded: bool = True) -> Scorer:
        """``texts_with``: how many of the ``texts`` documents hold each term (by its hash). ``guarded``: the names and
        numbers of a template decide, too."""
        names, terms, tf = cls.terms_of(templates)
        df = np.array([*(texts_with.get(int(t), 0) for t in terms), 0])
        weights = np.log((1 + texts) / (1 + df)) + 1
        vectors = tf * weights[:-1]
        short = guarded & (tf.sum(axis=1) <= 25)[:, None]
        needed = (tf > 0) & (np.isin(terms, _hashes(NAMES)) | np.isin(terms, _hashes([*"0123456789"])) & short) & guarded
        barred = (tf == 0) & np.isin(terms, _hashes(OTHERS)) & guarded
        return cls(names, terms, weights, vectors / np.linalg.norm(vectors, axis=1, keepdims=True),
                   needed.astype(float), barred.astype(float))

    def best(self, words: np.ndarray, unit: np.ndarray, units: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """For each unit (a line or a file; ``unit`` of each word) the best template (-1: none) and its cosine.

        The weight of the words that are no terms bounds the cosine; units that cannot reach ``least`` are left.
        """
        place = np.searchsorted(self.terms, words)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == words
        k = len(self.terms)
        cell, tf = np.unique(unit[known] * k + place[known], return_counts=True)
        of, term = cell // k, cell % k
        own = np.bincount(of, (tf * self.weights[term]) ** 2, units)
        strange = np.bincount(unit[~known], minlength=units) * self.weights[-1] ** 2
        could = (own > 0) & (own >= least**2 * (own + strange))
        template, cosine = np.full(units, -1), np.zeros(units)
        chosen = np.flatnonzero(could)
        row = np.full(units, -1)
        row[chosen] = np.arange(len(chosen))
        of_row, kept_term, kept = row[of], term, tf * self.weights[term]
        keep = of_row >= 0
        of_row, kept_term, kept = of_row[keep], kept_term[keep], kept[keep]
        odd = could[unit] & ~known
        order = np.lexsort((words[odd], unit[odd]))
        odd_unit, odd_word = unit[odd][order], words[odd][order]
        new = np.flatnonzero(np.r_[True, (odd_unit[1:] != odd_unit[:-1]) | (odd_word[1:] != odd_word[:-1])][:len(odd_unit)])
        odd_tf = np.diff(np.r_[new, len(odd_unit)])
        strange = np.bincount(row[odd_unit[new]], (odd_tf * self.weights[-1]) ** 2, len(chosen))
        for start in range(0, len(chosen), ROWS):
            n = min(ROWS, len(chosen) - start)
            a, b = np.searchsorted(of_row, [start, start + n])
            x = np.zeros((n, k))
            x[of_row[a:b] - start, kept_term[a:b]] = kept[a:b]
            all_cosines = np.round(x @ self.vectors.T / np.sqrt((x**2).sum(axis=1) + strange[start:start + n])[:, None], 6)
            has = (x > 0).astype(float)
            fits = (has @ self.needed.T == self.needed.sum(axis=1)) & (has @ self.barred.T == 0)
            all_cosines = np.where(fits, all_cosines, 0)
            top = all_cosines.argmax(axis=1)
            value = all_cosines[np.arange(n), top]
            template[chosen[start:start + n]] = np.where(value >= least, top, -1)
            cosine[chosen[start:start + n]] = np.where(value >= least, value, 0)
        return template, cosine


def _term_counts(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total, texts = WordHasher(ASCII_NO_WORD), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            own = batch.column("__text").to_pylist()
            for a, b in byte_slices(own, SLICE):
                words, counts = hasher.words(own[a:b])
                place = np.searchsorted(terms, words)
                place[place == len(terms)] = 0
                known = terms[place] == words
                unit = np.repeat(np.arange(b - a), counts)
                pairs = np.unique(unit[known] * len(terms) + place[known])
                total += np.bincount(pairs % len(terms), minlength=len(terms))
                texts += b - a
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(terms)), -1]), pa.array([*total.tolist(), texts])], ["term", "texts"])
    return run


def _blocks(counts: np.ndarray, of_doc: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each block of 2 to BLOCK_LINES lines with words of one document, with a marked line."""
    lines = np.flatnonzero(counts)
    seen = np.r_[0, np.cumsum(marked[lines])]
    first, last = [], []
    for n in range(2, min(BLOCK_LINES, len(lines)) + 1):
        starts = np.arange(len(lines) - n + 1)
        starts = starts[(seen[starts + n] > seen[starts]) & (of_doc[lines[starts]] == of_doc[lines[starts + n - 1]])]
        first.append(lines[starts])
        last.append(lines[starts + n - 1])
    return np.concatenate([*first, np.zeros(0, int)]), np.concatenate([*last, np.zeros(0, int)])


def _headers(scorer: Scorer, words: np.ndarray, counts: np.ndarray, of_doc: np.ndarray, marks: np.ndarray, least: float):
    """Document, template and cosine of the lines and blocks that match."""
    unit = np.repeat(np.arange(len(counts)), counts)
    template, cosine = scorer.best(words, unit, len(counts), least)
    hit = template >= 0
    found = [(of_doc[hit], template[hit], cosine[hit])]
    marked = np.bincount(unit[np.isin(words, marks)], minlength=len(counts)) > 0
    ends = np.cumsum(counts)
    first, last = _blocks(counts, of_doc, marked)
    for i in range(0, len(first), 20 * ROWS):
        a, b = (ends - counts)[first[i:i + 20 * ROWS]], ends[last[i:i + 20 * ROWS]]
        block = np.repeat(np.arange(len(a)), b - a)
        place = np.arange(len(block)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        template, cosine = scorer.best(words[place], block, len(a), least)
        hit = template >= 0
        found.append((of_doc[first[i:i + 20 * ROWS]][hit], template[hit], cosine[hit]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _scanned(scorer: Scorer, whole: Scorer | None, keep: tuple[str, ...], header: float, file: float):
    names = np.array([*scorer.names, None], object)
    whole_names = np.array([*(whole.names if whole else ()), None], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, marks = WordHasher(ASCII_NO_WORD), _hashes(MARKS)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in byte_slices(texts, SLICE):
                lines = [t.split(b"\n") for t in texts[a:b]]
                words, counts = hasher.words([line for own in lines for line in own])
                of_doc = np.repeat(np.arange(b - a), [len(own) for own in lines])
                doc_of_word = np.repeat(of_doc, counts)
                doc, template, cosine = _headers(scorer, words, counts, of_doc, marks, header)
                order = np.lexsort((template, -cosine, doc))            # a document's best line or block first
                matched: list[dict] = [{} for _ in range(b - a)]
                for i in order:
                    matched[doc[i]].setdefault(names[template[i]], float(cosine[i]))
                for own in matched:                                     # its two conditions are the first ones of the three
                    if own.get("BSD-3-Clause", 0) and "BSD-2-Clause" in own:
                        del own["BSD-2-Clause"]
                notice, notice_cosine = scorer.best(words, doc_of_word, b - a, file)
                file_name, file_cosine = names[notice], notice_cosine
                if whole:
                    body, body_cosine = whole.best(words, doc_of_word, b - a, BODY_COSINE)
                    better = body_cosine > file_cosine
                    file_name = np.where(better, whole_names[body], file_name)
                    file_cosine = np.where(better, body_cosine, file_cosine)
                best = [next(iter(own.items()), (None, 0.0)) for own in matched]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in keep), pa.array([n for n, _ in best], pa.string()),
                     pa.array([c for _, c in best], pa.float64()), pa.array([",".join(own) or None for own in matched], pa.string()),
                     pa.array(file_name, pa.string()), pa.array(file_cosine)],
                    [*keep, "header_license", "header_score", "header_licenses", "file_license", "file_score"])
    return run


def folder_of(path: Column) -> Column:
    """What stands before the last slash; "" for a path without one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def nearest(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """folder, from_folder, inherited: for each distinct folder the nearest of itself and its ancestors that is
    in ``licensed`` (folder, license). "" is the root and an ancestor of all."""
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    lines = folders.distinct().withColumn("ancestor", F.explode(F.array_distinct(up)))
    return (lines.join(licensed.select(F.col("folder").alias("ancestor"), "license"), "ancestor")
            .groupBy("folder").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "license")).alias("near"))
            .select("folder", F.col("near.ancestor").alias("from_folder"), F.col("near.license").alias("inherited")))


def license_scan(docs: DataFrame, path: Column, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 templates: dict | None = None, header: float = HEADER_COSINE, file: float = FILE_COSINE) -> DataFrame:
    """``keep`` columns, path, header_license, header_score, header_licenses, file_license, file_score, license, basis,
    from_folder.

    A line or block of adjacent lines whose cosine to a template is ``header`` or more is a header (the best counts;
    ties: the template listed first; header_licenses has all, the best first); a text whose whole words reach ``file``
    with a notice or BODY_COSINE with a licence's own text is a licence file of its folder, and so is one named like
    LICENSE or COPYING with a header. ``templates``: notices in place of the known ones; no licence texts then. A folder takes
    its best file (ties: the least name). basis: header, file, inherited (from from_folder, the nearest
    folder upwards with a licence file) or none. Null and empty texts have neither; a null path is the
    root folder. Document counts of the terms come from all rows. Repeated rows get equal results.
    """
    spark = prepare(docs.sparkSession)
    whole = {} if templates else bodies()
    templates = templates or TEMPLATES
    rows = docs.select(*keep, F.coalesce(path, F.lit("")).alias("path"), utf8(text_col).alias("__text"))
    terms = np.unique(np.concatenate([Scorer.terms_of(t)[1] for t in (templates, whole) if t]))
    counted = (rows.select("__text").mapInArrow(_term_counts(terms), "term long, texts long")
               .groupBy("term").agg(F.sum("texts").alias("texts")).collect())          # one row a template word
    counts = {r.term: r.texts for r in counted}
    n, texts_with = counts.get(-1, 0), {int(t): counts.get(i, 0) for i, t in enumerate(terms)}
    scorers = spark.sparkContext.broadcast((Scorer.of(templates, texts_with, n), Scorer.of(whole, texts_with, n, False) if whole else None))
    own = (*keep, "path")
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
    found = rows.mapInArrow(lambda batches: _scanned(*scorers.value, own, header, file)(batches),
                            f"{fields}, header_license string, header_score double, header_licenses string, file_license string, file_score double")
    found = stored(found.withColumn("folder", folder_of(F.col("path"))), "licenses")
    named = F.col("path").rlike(r"(?i)(^|/)(un)?licen[cs]e[^/]*$|(^|/)copying[^/]*$") & F.col("file_license").isNull()
    states = F.when(named, F.col("header_license")).otherwise(F.col("file_license"))
    score = F.when(named, F.col("header_score")).otherwise(F.col("file_score"))
    licensed = (found.where(states.isNotNull()).groupBy("folder")
                .agg(F.min(F.struct((-score).alias("off"), states.alias("license"))).alias("best"))
                .select("folder", "best.license"))
    heirs = nearest(found.select("folder"), licensed)
    basis = (F.when(F.col("header_license").isNotNull(), "header").when(F.col("file_license").isNotNull(), "file")
             .when(F.col("inherited").isNotNull(), "inherited").otherwise("none"))
    return (found.join(heirs, "folder", "left").withColumn("basis", basis)
            .select(*keep, "path", "header_license", "header_score", "header_licenses", "file_license", "file_score",
                    F.coalesce("header_license", "file_license", "inherited").alias("license"), "basis",
                    F.when(F.col("basis") == "inherited", F.col("from_folder")).alias("from_folder")))
