import math
from collections import Counter

import pytest

from millrace.llm import licenses as L


def cosine(text, template, templates=L.TEMPLATES):
    words = [Counter(L._WORD.findall(t.lower())) for _, t in templates]
    df = Counter(w for c in words for w in c)
    n = len(templates)

    def vector(t):
        return {w: k * (math.log((1 + n) / (1 + df[w])) + 1 if w in df else math.log(1 + n) + 1) for w, k in Counter(L._WORD.findall(t.lower())).items()}

    a, b = vector(text), vector(template)
    return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_best_equals_plain_cosine():
    index = L.Index()
    for line in ("Released under the MIT License", "licensed under the apache license version 2", "this work is GNU General Public License version 3 indeed", "a mat and a cat", "the license"):
        best = max(((round(cosine(line, t), 9), name) for name, t in L.TEMPLATES), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        got = index.best(L._WORD.findall(line.lower()), 0.3)
        assert (got is None) == (best[0] < 0.3)
        if got:
            assert math.isclose(got[0], best[0], abs_tol=1e-8)


@pytest.mark.parametrize("name,text", L.TEMPLATES)
def test_templates_find_themselves(name, text):
    assert L.detect_text("some words before\n" + text + "\nand after", L.Index()) == (name, 1.0, 1)


def test_whole_file():
    text = "\n".join(L.TEMPLATES[1][1].split())
    assert L.detect_text(text, L.Index())[::2] == ("MIT", -1)
    assert L.detect_text(None, L.Index()) is None and L.detect_text("", L.Index()) is None


def test_inheritance(spark):
    rows = [("a/LICENSE", "MIT"), ("a/b/x.txt", None), ("a/b/c/COPYING", "GPL-3.0"), ("a/b/c/d/y.txt", None), ("a/b/c/z.txt", "BSD"), ("q/y.txt", None), (None, None), ("LICENSE", "TOP"), ("top.txt", None), ("a/b/x.txt", None), ("ab/x.txt", None)]
    out = L.inherit(spark.createDataFrame(rows, "path string, own_license string")).collect()
    assert len(out) == len(rows)
    got = {r.path: (r.license, r.origin, r.inherited_from) for r in out}
    assert got["a/b/x.txt"] == ("MIT", "inherited", "a")
    assert got["a/b/c/d/y.txt"] == ("GPL-3.0", "inherited", "a/b/c")
    assert got["a/b/c/z.txt"] == ("BSD", "header", None)
    assert got["a/LICENSE"][:2] == ("MIT", "file")
    assert got["q/y.txt"] == got["top.txt"] == got["ab/x.txt"] == ("TOP", "inherited", ".")
    assert got[None] == (None, None, None)


def test_odd_rows(odd, none, sample):
    assert L.detect(odd, keep=("doc_id",)).count() == 9
    assert L.inherit(L.detect(none.withColumnRenamed("lang", "path"))).count() == 0
    has = {r.doc_id for r in sample.collect() if "icensed under" in (r.text or "") or "Released under" in (r.text or "")}
    assert {r.doc_id for r in L.detect(sample, keep=("doc_id",)).where("own_license IS NOT NULL").collect()} == has


@pytest.mark.parametrize("text,name", [
    ("Licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
    ("# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n# copyright notice and this permission notice appear in all copies.\n\nimport os", "ISC"),
    ("// This program is free software; you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation; either version 2 of the License, or\n// any later version.\n\nint main;", "GPL-2.0"),
])
def test_notices_over_lines_and_their_kin(text, name):
    assert L.detect_text(text, L.Index())[0] == name


def test_bsd_by_its_third_clause():
    opening = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    two = opening + "\n\n1. Redistributions of source code must retain the above copyright notice\n\n2. Redistributions in binary form must reproduce the above copyright notice"
    third = "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert L.detect_text(two, L.Index())[0] == "BSD-2-Clause"
    assert L.detect_text(two + third, L.Index())[0] == "BSD-3-Clause"


def test_query_equals_brute_force(spark):
    """The whole query on the smallest table: detection of every text, then a walk up each path."""
    from millrace.llm import queries

    sf, index = "/root/testdata/sf0.001", L.Index()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_licenses(spark, sf).collect()
    own = {r.doc_id: (L.detect_text(texts[r.doc_id], index) or (None,))[0] for r in rows}
    theirs = {}
    for path, name in sorted((r.path, own[r.doc_id]) for r in rows if own[r.doc_id]):  # documents share paths
        if path.endswith("/LICENSE"):
            theirs.setdefault(path.rpartition("/")[0], name)
    for r in rows:
        folder, want = r.path, own[r.doc_id]
        while want is None and "/" in folder:
            folder = folder.rpartition("/")[0]
            want = theirs.get(folder)
        assert (r.own_license, r.license) == (own[r.doc_id], want)
    assert len(rows) == len(texts)


def test_clashing_names_and_long_texts(spark, odd):
    from pyspark.sql import functions as F

    rows = [("a/LICENSE", "MIT"), ("a/x", None)]
    df = spark.createDataFrame(rows, "path string, own_license string").withColumns({c: F.lit(c) for c in ("above", "theirs", "_dir", "_file", "depth", "license", "c0", "c1")})
    out = {r.path: r for r in L.inherit(df).collect()}
    assert out["a/x"].license == "MIT" and out["a/x"].above == "above" and out["a/x"].theirs == "theirs" and out["a/x"].c0 == "c0"
    text = "alpha beta\n" * 50_000 + L.TEMPLATES[0][1] + "\n" + "gamma\n" * 50_000
    assert L.detect_text(text, L.Index())[::2] == ("MIT", 50_000)
