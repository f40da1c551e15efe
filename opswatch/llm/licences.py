"""Licence scans: sparse TF-IDF cosine to templates, and inheritance down a directory tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opswatch.llm.common import join_counted
from opswatch.operators.partition_sums import partition_sums
from opswatch.session import cut_lineage

# Public short notices and the openings of public licence texts, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    (
        "Artistic-1.0",
        'The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may be copied',
    ),
    ("Artistic-2.0", "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)
# What tells near licences apart, besides the numbers of their versions; and what denies a notice.
KINDS = frozenset(
    b"mit apache bsd gpl lgpl agpl lesser library affero documentation mozilla mpl artistic cc cc0 by-sa by-nc by-nd isc zlib eclipse boost".split()
)
DENIALS = frozenset(b"not never no without isn't aren't wasn't neither nor cannot".split())
_VERSION = re.compile(rb"v?\d{1,2}(\.\d{1,2})*|\d-clause")
#: Words before a notice, in its sentence, that may deny it.
_BEFORE = 4
#: A text of fewer words is no full licence text.
_FULL_WORDS = 100
#: Cosine from which a line or a window of words is a notice, and from which a whole file is a licence file.
NOTICE_FROM = 0.8
FILE_FROM = 0.5
#: Cosine of a whole text to a full licence text, and its distance to the next licence, from which it is that licence.
FULL_FROM, FULL_MARGIN = 0.9, 0.002
#: Names that make a file with a notice a licence file.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
_EDGE = b".,;:!?|\"'()[]{}<>*#/-"


def _term(word: bytes) -> bytes:
    return word.strip(_EDGE)


class _Terms(dict):
    """Numbers of template terms by word as written; -1 is any other term, -2 none."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        term = _term(word)
        value = self[word] = self.vocabulary.get(term, -1) if term else -2
        return value


def _telling(terms: Iterable[bytes]) -> frozenset[bytes]:
    """The terms among them that tell licences apart: kinds and versions."""
    return frozenset(t.removeprefix(b"v") if _VERSION.fullmatch(t) else t for t in terms if t in KINDS or _VERSION.fullmatch(t))


@dataclass(frozen=True)
class Templates:
    """Template vectors over their own vocabulary, and their terms' number; ``other_idf`` is for terms in no template."""

    names: tuple[str, ...]
    vocabulary: dict[bytes, int]
    idf: np.ndarray
    other_idf: float
    vectors: np.ndarray
    sizes: tuple[int, ...]
    telling: tuple[frozenset[bytes], ...]
    denials: tuple[int, ...]
    full: Templates | None = None

    def speaks(self, words: list[bytes], at: int, n: int, k: int) -> bool:
        """Whether the ``n`` words from ``at`` on, close to template ``k``, name its kind and version and no other, and do not deny it."""
        terms = [_term(w) for w in words[at : at + n]]
        if _telling(terms) != self.telling[k] or sum(t in DENIALS for t in terms) > self.denials[k]:
            return False
        for word in reversed(words[max(0, at - _BEFORE) : at]):
            if word[-1:] in b".!?;:":
                break
            if _term(word) in DENIALS or _term(word).endswith(b"n't"):
                return False
        return True

    def whole(self, words: list[bytes]) -> tuple[str | None, float]:
        """The full licence text that the words are, if one is near and the next licence is farther."""
        c = self.cosines(words)
        k = int(c.argmax())
        others = [x for x, name in zip(c, self.names, strict=True) if name != self.names[k]]
        sure = c[k] >= FULL_FROM and c[k] - max(others, default=0.0) >= FULL_MARGIN
        return (self.names[k], float(c[k])) if sure else (None, 0.0)

    def cosines(self, words: list[bytes]) -> np.ndarray:
        """Cosine of a bag of words to each template."""
        counts = Counter(t for w in words if (t := _term(w)))
        known = np.zeros(len(self.idf))
        other = 0.0
        for term, n in counts.items():
            k = self.vocabulary.get(term)
            if k is None:
                other += (n * self.other_idf) ** 2
            else:
                known[k] = n * self.idf[k]
        norm = np.sqrt(known @ known + other)
        return self.vectors @ known / norm if norm else np.zeros(len(self.names))

    def scan(self, text: bytes, terms: _Terms) -> tuple[str | None, float, str | None, float]:
        """The best notice's licence and cosine, and the best licence of the whole text with its cosine if that may reach ``FILE_FROM``.

        Notices are lines, and windows as long as a template, whose words may be wrapped over lines or stand in a longer one.

        A line's terms outside the vocabulary bound its cosine from above; only lines that the bound leaves are
        compared with the templates.
        """
        lines = text.lower().split(b"\n")
        words = [line.split() for line in lines]
        sizes = np.array([len(w) for w in words])
        codes = np.fromiter((terms[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        weight = np.where(codes >= 0, self.idf[np.maximum(codes, 0)], np.where(codes == -1, self.other_idf, 0.0)) ** 2
        line = np.repeat(np.arange(len(lines)), sizes)
        inside = np.bincount(line, np.where(codes >= 0, weight, 0), minlength=len(lines))
        outside = np.bincount(line, np.where(codes >= 0, 0, weight), minlength=len(lines))
        # repeats only raise a term's part: inside terms by at most their number in the line
        most = inside * np.maximum(np.bincount(line, codes >= 0, minlength=len(lines)), 1)
        near = np.flatnonzero((inside > 0) & (most >= NOTICE_FROM**2 * (most + outside)))
        begin = np.cumsum(sizes) - sizes
        found = []
        for i in near:
            c = self.cosines(words[i])
            found += [(float(c[k]), int(begin[i]), int(k), len(words[i])) for k in np.flatnonzero(c >= NOTICE_FROM)]
        every = [w for ws in words for w in ws]
        found += self.windows(every, codes, weight)
        best, licence = 0.0, None
        passed = [(-round(c, 12), at, k) for c, at, k, n in found if c >= NOTICE_FROM and self.speaks(every, at, n, k)]
        if passed:
            c, _, k = min(passed)
            best, licence = -c, self.names[k]
        file_best, file_licence = 0.0, None
        known = np.bincount(codes[codes >= 0], minlength=len(self.idf)) * self.idf
        # repeats of other terms only lower the cosine
        if (self.vectors @ known).max() >= FILE_FROM * np.sqrt(known @ known + outside.sum()) - 1e-9 and known.any():
            c = np.where([t <= _telling(map(_term, every)) for t in self.telling], self.cosines(every), 0.0)
            k = int(c.argmax())
            if self.speaks(every, 0, len(every), k) or licence == self.names[k]:
                file_best, file_licence = float(c[k]), self.names[k]
        if self.full is not None and len(every) > _FULL_WORDS:
            name, near = self.full.whole(every)
            if name is not None:
                return name, near, name, near
        return licence, best, file_licence, file_best

    def windows(self, words: list[bytes], codes: np.ndarray, weight: np.ndarray) -> list[tuple[float, int, int, int]]:
        """Cosine, first word, template and words of the windows of as many terms as a template, across lines, that may be its notice.

        Templates with too few of their terms in the text have none. In a window, a term's repeats only lower the cosine below
        what its running sums give; windows that this bound leaves are compared word by word.
        """
        place = np.flatnonzero(codes != -2)
        codes, weight = codes[place], weight[place]
        inside = codes >= 0
        present = np.zeros(len(self.idf))
        present[codes[inside]] = 1
        norm = np.append(0, np.cumsum(weight))
        found = []
        for k in np.flatnonzero(self.vectors**2 @ present >= NOTICE_FROM**2 - 1e-9):
            n = min(self.sizes[k], len(codes))
            part = np.append(0, np.cumsum(np.where(inside, (self.vectors[k] * self.idf)[np.maximum(codes, 0)], 0)))
            bound = NOTICE_FROM * np.sqrt(norm[n:] - norm[:-n])
            for at in np.flatnonzero(part[n:] - part[:-n] >= bound - 1e-6):
                span = int(place[at + n - 1] + 1 - place[at])
                c = self.cosines(words[place[at] : place[at] + span])[k]
                found.append((float(c), int(place[at]), int(k), span))
        return found


def licence_texts(folder: str) -> tuple[tuple[str, str], ...]:
    """Full licence texts of a folder on the driver, each named by its file."""
    return tuple((f.name, f.read_text("utf-8", "replace")) for f in sorted(Path(folder).iterdir()) if f.is_file() and not f.is_symlink())


def fit_templates(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, texts: tuple[tuple[str, str], ...] = ()
) -> Templates:
    """Weigh the templates' terms by their inverse document frequency over all documents; of full ``texts`` likewise.

    ``idf = ln((1 + documents) / (1 + documents with the term)) + 1``; terms outside the templates get the value of a term in
    no document, so their counts, which grow with the corpus, are not needed.
    """
    full = fit_templates(docs, texts) if texts else None
    bags = [[t for w in text.encode().lower().split() if (t := _term(w))] for _, text in templates]
    vocabulary = {t: i for i, t in enumerate(sorted({t for bag in bags for t in bag}))}

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, terms = np.zeros(len(vocabulary) + 1), _Terms(vocabulary)
        for batch in batches:
            for text in batch.column(0):
                found = {terms[w] for w in set((text.as_py() or b"").lower().split())}
                total[[c for c in found if c >= 0]] += 1
                total[-1] += 1
        return total

    total = partition_sums(docs.select(F.col("text").cast("binary").alias("text")), count)
    total = np.zeros(len(vocabulary) + 1) if total is None else total
    idf = np.log((1 + total[-1]) / (1 + total[:-1])) + 1
    vectors = np.zeros((len(bags), len(vocabulary)))
    for row, bag in zip(vectors, bags, strict=True):
        for term, n in Counter(bag).items():
            row[vocabulary[term]] = n * idf[vocabulary[term]]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return Templates(
        tuple(n for n, _ in templates), vocabulary, idf, float(np.log(1 + total[-1]) + 1), vectors, tuple(len(b) for b in bags),
        tuple(_telling(b) for b in bags), tuple(sum(t in DENIALS for t in b) for b in bags), full,
    )


def scan_licences(
    files: DataFrame,
    path: str | Column = "path",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    texts: tuple[tuple[str, str], ...] = (),
) -> DataFrame:
    """Each file's licence, found in it or inherited from the nearest directory above it.

    ``files`` has ``doc_id``, ``text`` and a path with ``/`` (column or expression). Result: ``doc_id``, ``path``, ``licence``,
    ``score`` (cosine of the notice), ``origin`` (``notice``, ``inherited`` or null), ``source_path`` (the file that says so). A
    line, or a run of as many words as a template has, is a notice when its TF-IDF cosine to the template reaches ``NOTICE_FROM``; the
    best one counts, ties go to the earlier one. It must name the template's kind and version and no other (near licences differ in
    little else), and must not be denied ("not released under ..."). With ``texts`` (of ``licence_texts``) a file that is one of them,
    clearly nearer than any other, has that licence. A file whose whole text reaches ``FILE_FROM`` is a licence file, with or without such a
    notice (the cosine is then the whole text's); one with a notice also is when its name says so. A licence file
    speaks for its directory: of several the one with the highest cosine, then the least path. A file without a notice
    takes the licence of the nearest directory, its own or one above it, that has a licence file.

    Null texts have no notice; a null path is the root directory's; repeated rows are each answered; other columns are ignored; an
    empty table gives no rows. Directories are joined, not files: a directory with a third of all files is one row there.
    """
    spark = files.sparkSession
    where = F.regexp_replace(F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit("")), "^/+|/+$", "")
    model = spark.sparkContext.broadcast(fit_templates(files, templates, texts))  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms(model.value.vocabulary)
        for batch in batches:
            found = [model.value.scan(t.as_py() or b"", terms) for t in batch.column(2)]
            found = [(n, s, fn, fs) if n is not None or fs < FILE_FROM else (fn, fs, fn, fs) for n, s, fn, fs in found]
            licence, score, file_licence, file_score = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [pa.array(licence, pa.string()), pa.array(score, pa.float64()), pa.array(file_licence, pa.string()), pa.array(file_score, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "path", "licence", "score", "file_licence", "file_score"])

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), where.alias("path"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, path string, licence string, score double, file_licence string, file_score double"
    scanned = rows.mapInArrow(run, schema).withColumn("dir", F.regexp_replace(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "/$", ""))
    scanned = cut_lineage(scanned)
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES)
    speaking = scanned.where(F.col("licence").isNotNull() & (named | (F.col("file_score") >= FILE_FROM)))
    says = F.when(F.col("file_score") >= FILE_FROM, F.col("file_licence")).otherwise(F.col("licence"))
    first = F.min_by(F.struct(says.alias("licence"), "score", F.col("path").alias("source_path")), F.struct(-F.col("score"), "path"))
    of_dir = cut_lineage(speaking.groupBy("dir").agg(first.alias("said")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    lines = scanned.select("dir").distinct().select(F.col("dir").alias("of"), F.posexplode(above).alias("depth", "dir"))
    nearest = join_counted(lines, of_dir, ["dir"], "inner", 256).groupBy("of").agg(F.max_by("said", "depth").alias("said"))
    nearest = cut_lineage(nearest.withColumnRenamed("of", "dir"))
    joined = join_counted(scanned, nearest, ["dir"], "left", 256)
    own = F.col("licence").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("licence", "said.licence").alias("licence"),
        F.when(own, F.col("score")).otherwise(F.col("said.score")).alias("score"),
        F.when(own, "notice").when(F.col("said").isNotNull(), "inherited").alias("origin"),
        F.when(own, F.col("path")).otherwise(F.col("said.source_path")).alias("source_path"),
    )
