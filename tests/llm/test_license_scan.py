"""Licence lines of relatives against each other."""

import pytest

from tidemark.llm import license_scan

CC = "This work is licensed under a Creative Commons Attribution {}4.0 International License"
LINES = [
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-NC-SA 4.0.", ""),
    ("Licensed under CC BY-NC 4.0.\nNd begins another sentence.", "cc-by-nc"),
    (CC.format(""), "cc-by"),
    (CC.format("ShareAlike "), "cc-by-sa"),
    (CC.format("NonCommercial "), "cc-by-nc"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This work is licensed under the GNU Lesser General Public License, version 3", "lgpl"),
    ("This work is licensed under the Mozilla Public License, version 2", ""),
    ("Licensed under the Mozilla Public License, Version 2.0", ""),
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("Licensed under CC BY-SA 4.0. Some words stand between. Licensed under CC BY 4.0.", "cc-by,cc-by-sa"),
    (license_scan.NOTICES["mit"].replace("without limitation", "with no limit"), "mit"),
    (license_scan.NOTICES["gpl"].replace("GNU General", "GNU Lesser General"), "lgpl"),
]


def test_relatives_are_told_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert {LINES[i][0]: r.labels for i, r in got.items()} == dict(LINES)
    assert [got[i].base_labels for i in range(5)] == ["cc-by"] * 5 and got[10].score < 0.6


def test_a_template_of_over_64_words(spark, monkeypatch):
    long_ = " ".join(f"w{i}" for i in range(90))
    monkeypatch.setattr(license_scan, "NOTICES", {"long": long_})
    monkeypatch.setattr(license_scan.template_table, "__defaults__", (license_scan.PHRASES, {"long": long_}))
    docs = spark.createDataFrame([(1, long_)], "doc_id long, text string")
    assert [(r.labels, r.score) for r in license_scan.scan(docs).collect()] == [("long", 1.0)]


def test_reversed_and_thinned_notices_get_no_label(spark):
    words = license_scan.NOTICES["bsd"].split()
    pairs = [w for i in range(len(words) - 2, -1, -2) for w in words[i : i + 2]]
    thin = [x for w in license_scan.NOTICES["isc-text"].split() for x in (w, "and", "other", "words", "of", "mine")]
    docs = spark.createDataFrame([(1, " ".join(pairs)), (2, " ".join(reversed(words))), (3, " ".join(words)), (4, " ".join(thin))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert got == {1: "", 2: "", 3: "bsd", 4: ""}


@pytest.mark.parametrize("name", [n for n in license_scan.NOTICES if n.endswith("-text")])
def test_whole_licences_are_verified_with_changes(spark, name):
    text = license_scan.NOTICES[name]
    words = text.split()
    dropped = " ".join(w for i, w in enumerate(words) if i % 17)
    put_in = " ".join(x for i, w in enumerate(words) for x in ((w, "really") if i % 23 == 22 else (w,)))
    docs = spark.createDataFrame([(1, "Before it. " + text + " After it."), (2, dropped), (3, put_in), (4, " ".join(words[: len(words) // 3][::-1]))], "doc_id long, text string")
    got = {r.doc_id: (r.labels.split(","), r.score) for r in license_scan.scan(docs).collect()}
    label = license_scan.SAME[name]
    assert label in got[1][0] and got[1][1] == 1.0 and label in got[2][0] and label in got[3][0] and label not in got[4][0]
