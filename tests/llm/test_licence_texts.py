"""Licence scans on full licence texts, negated lines and unknown licences."""

import os

import pytest

from opswatch.llm.licences import licence_texts, scan_licences

#: Where systems of the Debian family keep the texts of common licences.
TEXTS = "/usr/share/common-licenses"
#: File name there: licence.
KNOWN = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1",
    "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def scanned(spark, sf, files, **settings):
    corpus = [(i, t, f"corpus/{i}") for i, t in enumerate(r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect())]
    df = spark.createDataFrame(corpus + [(10_000 + i, t, p) for i, (p, t) in enumerate(files)], "doc_id long, text string, path string")
    found = {r["doc_id"] - 10_000: r for r in scan_licences(df, **settings).where("doc_id >= 10000").collect()}
    return [(found[i]["licence"], found[i]["origin"]) for i in range(len(files))]


@pytest.mark.skipif(not os.path.isdir(TEXTS), reason="no licence texts on this machine")
@pytest.mark.parametrize("full", [False, True])
def test_full_texts_of_licences_and_their_versions(spark, sf, full):
    texts = licence_texts(TEXTS)
    files = [(f"p{i}/{name}", text) for i, (name, text) in enumerate(texts) if name in KNOWN]
    below = [(f"p{i}/src/x", "nothing of the kind") for i, (name, _) in enumerate(texts) if name in KNOWN]
    named = tuple((KNOWN[n], t) for n, t in texts if n in KNOWN) if full else ()
    got = scanned(spark, sf, files + below, texts=named)
    want = [KNOWN[name] for name, _ in texts if name in KNOWN]
    assert len(want) >= 10 and got[: len(files)] == [(w, "notice") for w in want]
    if full:  # a whole licence text speaks for its directory whatever its name
        assert got[len(files) :] == [(w, "inherited") for w in want]


def test_what_is_denied_or_unknown_is_no_notice(spark, sf):
    files = [
        ("a/x", "This project is not released under the MIT License."), ("a/y", "plain"),
        ("b/x", "It isn't licensed under the Apache License, Version 2.0."), ("c/x", "Released under the FooBar License."),
        ("d/x", "Licensed under the Apache License, Version 1.1."), ("e/x", "This work is licensed under the GNU General Public License, version 7."),
        ("f/x", "It does not matter. Released under the MIT License."), ("g/x", "Released under this License."),
        ("h/x", "This work is licensed under the GNU General Public License, version 2."),
    ]
    got = scanned(spark, sf, files)
    assert [g[0] for g in got] == [None] * 6 + ["MIT", None, "GPL-2.0"]
