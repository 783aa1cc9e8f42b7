"""Licence notices anywhere in a text, and full texts."""

from __future__ import annotations

import random

from claimloom.llm import license_scan
from tests.llm.util import docs


def test_notices_inside_lines_and_full_texts(spark):
    full = license_scan.all_templates()
    apache = license_scan.TEMPLATES["Apache-2.0"][1]
    texts = [
        (1, "The code of this page is Released under the MIT License.", "MIT"),
        (2, "x = 1\n" + apache.replace(". ", ".\n") + "\nimport os\nprint(x)", "Apache-2.0"),
        (3, "some prose before " + apache + " and some prose after it " * 9, "Apache-2.0"),
        (4, "Copyright (c) 2020 A. Person\n" + full["BSD-2-Clause"][-1], "BSD-2-Clause"),
        (5, "We use this. " + full["LGPL-3.0"][0].replace(" ", "\n") + " Thanks.", "LGPL-3.0"),
        (6, full["GPL-3.0"][-1].replace("\n", " "), "GPL-3.0"),
        (7, "It is licensed under CC BY-SA 4.0. Read on.", "CC-BY-SA-4.0"),
        (8, full["ISC"][-1] + full["Unlicense"][-1], "ISC,Unlicense"),
        (9, "We met under the old bridge, and a license was not needed.", ""),
        (10, "Released under the MIT License. Released under the MIT License.", "MIT"),
        (11, full["MPL-2.0"][0], "MPL-2.0"), (12, "so: " + full["AGPL-3.0"][0], "AGPL-3.0"),
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(docs(spark, [x[:2] for x in texts])).collect()}
    assert {i: got[i].licenses for i in got} == {i: n for i, _, n in texts}
    assert got[10].n_matches == 2


def test_windows_against_brute_force():
    rng = random.Random(3)
    words = "released under the mit license version of a b c".split()
    t = license_scan.Templates({"A": ["released under the mit license"], "B": ["under the license of the a version of the b"]})
    some = 0
    for _ in range(800):
        w = [rng.choice(words) for _ in range(rng.randrange(2, 22))]
        if rng.random() < 0.3:
            y = rng.choice(["released under the mit license", "under the license of the a version of the b"]).split()
            del y[rng.randrange(len(y))]
            w[len(w) // 2 : len(w) // 2] = y
        best = 0.0
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                b = license_scan.bigrams(" ".join(w[i:j]))
                best = max([best, *(2 * (b & x).total() / (b.total() + n) for _, x, n in t.all)])
        found = t.scan(" ".join(w))
        assert bool(found) == (best >= t.dice)
        some += bool(found)
    assert some > 50
