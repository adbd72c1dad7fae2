"""Licence scan: held-out notices, other uses of the words, odd rows."""

import pytest

from salestide.llm import licences

PLAIN = "The river runs past the town. Nobody there knows why it was built. Old houses stand in rows"
NOTICES = {
    1: ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    2: ("Released under the MIT License.", "mit"),
    3: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    4: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    5: ("All rights reserved.", "proprietary"),
    6: ("This program is licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
    7: ("This book is licensed under CC BY 4.0.", "cc-by"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f"{PLAIN}.\n{text}\n{PLAIN} again.") for i, (text, _) in NOTICES.items()]
    rows += [(100 + i, f"{PLAIN} and number {i}.\n" * 3) for i in range(120)]
    rows += [(300, None), (301, ""), (302, "His driving licence was taken away by the court last year."), (303, "They talked about copyright all day long."),
             (304, f"{PLAIN}. Released under the MIT License. All rights reserved."), (304, f"{PLAIN}. Released under the MIT License. All rights reserved."), (None, "Released under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc, r.licences, r.notices, r.unknown) for r in licences.by_document(docs).collect()), key=str)


def test_notices(found):
    got = {d: (names, n, u) for d, names, n, u in found}
    assert {i: got[i] for i in NOTICES} == {i: ([family], 1, 0) for i, (_, family) in NOTICES.items()}


def test_other_rows(found):
    got = {d: (names, n, u) for d, names, n, u in found}
    assert got[300] == got[301] == ([], 0, 0)
    assert got[302] == got[303] == ([], 0, 1)
    assert [x[1:] for x in found if x[0] == 304] == [(["mit", "proprietary"], 2, 0)] * 2
    assert got[None] == (["mit"], 1, 0)
    assert all(got[100 + i] == ([], 0, 0) for i in range(120))


def test_empty_table(spark):
    assert licences.by_document(spark.createDataFrame([], "doc_id long, text string")).count() == 0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for\nany purpose with or without fee is hereby granted, provided that",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License.",
}
SHORT = {"gpl": "Distributed under GPL-3.0", "cc-by-sa": "Distributed under CC-BY-SA-4.0"}


def test_wrapped_and_short_notices(spark):
    rows = [(i, f"{PLAIN}.\n\n{text}\n\n{PLAIN} again.") for i, text in enumerate([*WRAPPED.values(), *SHORT.values()])]
    rows += [(100 + i, f"{PLAIN} and number {i}.\n" * 3) for i in range(120)]
    got = {r.doc: (r.licences, r.notices) for r in licences.by_document(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(6)] == [([family], 1) for family in [*WRAPPED, *SHORT]]


def test_runs_are_bounded():
    text = "\n".join(["#"] * 4000 + ["# Released under the MIT License."] + ["#"] * 4000)
    found = licences.pieces(text)
    assert found == [(4000, 4000, "# Released under the MIT License.")]
    # many short lines with words: at most MOST_LINES runs from each
    text = "\n".join(["a"] * 3000 + ["the license of"] + ["b"] * 3000)
    found = licences.pieces(text)
    assert len(found) <= licences.MOST_LINES**2 and max(len(p) for *_, p in found) < 100
    # no blank line, one long line
    text = "word " * 200_000 + "license"
    assert len(licences.pieces(text)) == 1


def plain_similarity(paragraph, family):
    import re

    own = set(re.findall("[a-z0-9]+", paragraph.lower()))
    shares = [len(set(re.findall("[a-z0-9]+", t.lower())) & own) / len(set(re.findall("[a-z0-9]+", t.lower()))) for t in licences.TEMPLATES.get(family, [])]
    return max(shares, default=0.0)


def test_template_comparison_is_the_plain_one(spark):
    rows = [(text, family) for text, _ in NOTICES.values() for family in [*licences.TEMPLATES, licences.UNKNOWN]]
    rows += [(t, "mit") for t in WRAPPED.values()]
    got = licences.confirmed(spark, spark.createDataFrame(rows, "paragraph string, family string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.similarity == pytest.approx(plain_similarity(r.paragraph, r.family))


def test_limits():
    import numpy as np

    limit = licences._limit
    assert limit(np.array([0.9, 0.8, 0.3]), np.array([True, True, True])) == 0.5
    assert limit(np.array([0.9, 0.8, 0.7]), np.array([True, True, False])) == 0.8
    # a wrong one among equals spoils them all
    assert limit(np.array([0.9, 0.9]), np.array([True, False])) == float("inf")
    assert limit(np.array([]), np.array([], bool)) == float("inf")


HELD = [
    ("The scripts in this folder are licensed under the MIT License.", "mit"), ("Everything here is licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Our tools are distributed under AGPL-3.0.", "agpl"), ("subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Released under CC0 1.0 Universal.", "cc0"), ("This library is licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
    ("Copyright 2016 the company. All rights reserved.", "proprietary"), ("Released under the ISC License.", "isc"),
    ("All rights reserved rooms were taken by the guests.", None), ("He lost the license that the state had granted him.", None),
    ("The museum opens to the public on Sundays with the permission of the mayor.", None), ("Copyright law is taught at the university.", None),
]


def test_held_out_notices_and_clashing_columns(spark):
    rows = [(i, f"{PLAIN}.\n{text}\n{PLAIN}", "x", "y") for i, (text, _) in enumerate(HELD)]
    rows += [(100 + i, f"{PLAIN} and number {i}.\n" * 3, "x", "y") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string, row_key string")
    scanner = licences.fit(spark, docs)
    assert len(set(scanner.limits)) > 2
    got = {r.doc: r.licences for r in licences.by_document(docs).collect() if r.doc < 100}
    right = sum(got[i] == ([family] if family else []) for i, (_, family) in enumerate(HELD))
    assert right >= len(HELD) - 1, got
