"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Units are every line of a text, every block of lines without an empty line between them, the header
(the comment lines that a text begins with) and the text as a whole, so that a notice in a header, over
several lines, anywhere else and a licence file are all seen; whole texts are read. A unit's vector
holds its words' frequency times idf (idf over the templates; words that no template has get the
largest), and its cosine to a template must reach `threshold`. The best unit of a text names its
licence; ties go to the smaller licence name, then to the earlier line. A licence that has all terms
of another and one more (REFINES) wins over that one where a unit of the text has its own term.

A file with a licence of its own keeps it. A file whose name marks it as a licence file (LICENSE,
LICENCE, COPYING, NOTICE) gives its licence to its directory, ties to the smaller path. Every other
file inherits from the nearest directory above it that has one. Only distinct directories are joined
with their ancestors; files join their own directory.

Detections are written once; directories, licence files and the result read them from there.

Null and empty texts match nothing; a null path neither gives nor inherits. Repeated rows stay repeated,
an empty table gives no rows. Other columns pass through inherit(), but for those that it adds, which
replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, small_batches

#: Fixed wording of common licence notices: licence name and a notice's text.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License, CC BY-SA 4.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)
#: A licence and the one whose terms it has besides its own.
REFINES = {"BSD-3-Clause": "BSD-2-Clause"}
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
_WORD = re.compile(r"[a-z0-9]+")
_COMMENT = re.compile(r"\s*(#|//|/\*|\*|--|;|%|<!--)")


class Index:
    """Templates as sparse unit vectors with postings by term."""

    def __init__(self, templates=TEMPLATES):
        counts = [Counter(_WORD.findall(t.lower())) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        n = len(templates)
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
        self.other = math.log(1 + n) + 1
        self.names = [name for name, _ in templates]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, c in enumerate(counts):
            v = {w: f * self.idf[w] for w, f in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            for w, x in v.items():
                self.postings.setdefault(w, []).append((k, x / norm))

    def best(self, tokens: list[str], threshold: float) -> tuple[float, str] | None:
        idf = self.idf
        known = Counter([w for w in tokens if w in idf])
        if not known:
            return None
        inside = sum((f * idf[w]) ** 2 for w, f in known.items())
        # the part of the vector inside the vocabulary bounds the cosine; words outside lower it
        n_out = len(tokens) - known.total()
        if inside < threshold**2 * (inside + n_out * self.other**2):
            return None
        outside = sum((f * self.other) ** 2 for w, f in Counter(w for w in tokens if w not in idf).items())
        norm = math.sqrt(inside + outside)
        score: Counter[int] = Counter()
        for w, f in known.items():
            x = f * idf[w] / norm
            for k, y in self.postings[w]:
                score[k] += x * y
        top = sorted((-round(s, 9), self.names[k]) for k, s in score.items())[0]
        return (-top[0], top[1]) if -top[0] >= threshold else None


def detect_text(text: str | None, index: Index, threshold: float = 0.6) -> tuple[str, float, int] | None:
    """(licence, cosine, line), the line counted from 0, -1 for the text as a whole."""
    raw = (text or "").lower().split("\n")
    lines = [_WORD.findall(line) for line in raw]
    units = [(k, tokens) for k, tokens in enumerate(lines) if tokens]
    start = 0
    for k in range(len(raw) + 1):
        if k == len(raw) or not raw[k].strip():
            if 1 < k - start < len(raw):
                units.append((start, [w for line in lines[start:k] for w in line]))
            start = k + 1
    top = next((k for k, line in enumerate(raw) if line.strip() and not _COMMENT.match(line)), len(raw))
    if 1 < top < len(raw):
        units.append((0, [w for line in lines[:top] for w in line]))
    units.append((1 << 60, [w for line in lines for w in line]))
    found = [(-b[0], b[1], k) for k, tokens in units if tokens and (b := index.best(tokens, threshold))]
    if not found:
        return None
    names = {f[1] for f in found}
    less = {REFINES[n] for n in names if n in REFINES}
    score, name, line = min(f for f in found if f[1] not in less)
    return name, -score, -1 if line == 1 << 60 else line


def detect(files: DataFrame, text: str = "text", keep: tuple[str, ...] = ("path",), threshold: float = 0.6, templates=TEMPLATES) -> DataFrame:
    """Columns `keep` with own_license, score and line (null where nothing matches)."""
    small_batches(files.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = files.select(*keep).schema.add("own_license", "string").add("score", "double").add("line", "long")
    arrow = to_arrow_schema(out)
    index = Index(templates)

    def run(batches):
        for batch in batches:
            found = [detect_text(t, index, threshold) or (None, None, None) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), list(arrow)[-3:], strict=True)] if found else [pa.array([], f.type) for f in list(arrow)[-3:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], schema=arrow)

    return files.select(*keep, F.col(text).alias("_text")).mapInArrow(run, out)


def _directory(path):
    own = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))
    return F.when(path.isNotNull(), F.regexp_replace(own, "^$", "."))


def inherit(found: DataFrame) -> DataFrame:
    """found(path, own_license, …) with license, origin (file, header, inherited or null) and
    inherited_from (a directory; '.' is the top)."""
    added = ("license", "origin", "inherited_from")
    names = [c for c in found.columns if c not in added]
    safe = [f"c{i}" for i in range(len(names))]
    rows = save(found.select(*names).toDF(*safe), "licenses-found")
    path, given_name = F.col(safe[names.index("path")]), F.col(safe[names.index("own_license")])
    rows = rows.withColumn("_dir", _directory(path)).withColumn("_file", path.rlike(LICENSE_FILE))
    licence = F.struct(path.alias("path"), given_name.alias("own_license"))
    given = rows.where(F.col("_file") & given_name.isNotNull() & F.col("_dir").isNotNull()).groupBy("_dir").agg(F.min(licence).alias("m")).select(F.col("_dir").alias("above"), F.col("m.own_license").alias("theirs"))
    dirs = rows.where("_dir IS NOT NULL").select("_dir").distinct()
    parts = F.split("_dir", "/")
    above = F.when(F.col("_dir") == ".", F.array(F.struct(F.lit(0).alias("depth"), F.lit(".").alias("above")))).otherwise(
        F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit(".").alias("above"))), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above"))))
    )
    nearest = dirs.select("_dir", F.explode(above).alias("a")).select("_dir", "a.depth", "a.above").join(given, "above").groupBy("_dir").agg(F.max(F.struct("depth", "above", "theirs")).alias("n")).select("_dir", "n.above", "n.theirs")
    out = rows.join(nearest, "_dir", "left")
    own = given_name.isNotNull()
    return out.select(
        *[F.col(c).alias(n) for c, n in zip(safe, names, strict=True)],
        F.coalesce(given_name, "theirs").alias("license"),
        F.when(own & F.col("_file"), "file").when(own, "header").when(F.col("theirs").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("above")).alias("inherited_from"),
    )
