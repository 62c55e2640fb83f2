import os
import shutil
import textwrap

import pytest
from pyspark.sql import functions as F

from tallygrid.llm import licenses as L

MIT, GPL = L.TEMPLATES["MIT"], L.TEMPLATES["GPL-3.0"]
ROWS = [
    (1, "/r/LICENSE", MIT), (2, "/r/a/x", "some words here"), (3, "/r/a/b/y", f"code code code\n# {GPL}\nmore code " * 40), (4, "/r/a/LICENSE", "this is " + GPL.upper()),
    (5, "/r/a/b/c/z", None), (6, "/other/z", ""), (7, "/r/top", "words " * 30000), (8, None, "lost"), (2, "/r/a/x", "some words here"), (9, "/r/a/COPYING", MIT),
]


def test_matches_and_inheritance(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, path string, text string, licence string").repartition(3)
    got = {r.doc_id: (r.licence, r.how, r.from_doc) for r in L.scan(docs, F.col("path"), L.fit(docs)).collect()}
    assert got[1] == ("MIT", "file", 1) and got[4] == ("GPL-3.0", "file", 4) and got[3] == ("GPL-3.0", "header", 3)
    assert got[2] == ("GPL-3.0", "inherited", 4) and got[5] == ("GPL-3.0", "inherited", 4) and got[7] == ("MIT", "inherited", 1)
    assert got[6] == (None, "none", None) and got[8] == (None, "none", None)
    assert L.scan(docs, F.col("path"), L.fit(docs)).count() == len(ROWS)


def wrapped(text, mark="# ", width=60):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_real_texts_headers_and_tags(spark):
    body = "def f(x):\n    return x + one\n\n" * 30
    copyright = "Copyright (c) 2001 Some Person\n\n"
    mit, apache, gpl = L.TEMPLATES["MIT#text"], L.TEMPLATES["Apache-2.0#header"], L.TEMPLATES["GPL-2.0#header"]
    grant, end = mit.split(" THE SOFTWARE IS")
    rows = [
        (1, "/m/LICENSE", "MIT License\n\n" + copyright + wrapped(grant, "", 75) + "\n\n" + wrapped("THE SOFTWARE IS" + end, "", 75)), (2, "/m/x.py", body),
        (3, "/b2/LICENSE", copyright + wrapped(L.TEMPLATES["BSD-2-Clause#text"], "")), (4, "/b3/LICENSE", copyright + wrapped(L.TEMPLATES["BSD-3-Clause#text"], "")),
        (5, "/i/LICENSE", wrapped(L.TEMPLATES["ISC#text"], "")), (6, "/p/LICENSE", wrapped(L.TEMPLATES["MPL-2.0#header"], "")),
        (7, "/x/a.py", f"#!/bin/x\n#\n{wrapped(apache)}\n#\n" + body), (8, "/x/b.c", f"/*\n{wrapped(gpl, ' * ')}\n */\n\n" + body),
        (9, "/x/c.c", "// SPDX-License-Identifier: MPL-2.0\n" + body), (10, "/x/d.c", "// SPDX-License-Identifier: Zlib\n" + body),
        (11, "/x/e.py", "# " + L._GRANT_APACHE.replace(", ", ",\n# ") + "\n#\n#    http://somewhere\n" + body), (12, "/x/f.py", body),
        (13, "/x/g.py", wrapped(L._GRANT_MIT) + "\n\n" + body), (14, "/x/h.py", "Released under the MIT\nLicense.\n\n" + body),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.how) for r in L.scan(docs, F.col("path"), L.fit(docs)).collect()}
    want = {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("BSD-2-Clause", "file"), 4: ("BSD-3-Clause", "file"), 5: ("ISC", "file"), 6: ("MPL-2.0", "file")}
    want |= {7: ("Apache-2.0", "header"), 8: ("GPL-2.0", "header"), 9: ("MPL-2.0", "header"), 10: ("Zlib", "header"), 11: ("Apache-2.0", "header"), 12: (None, "none"), 13: ("MIT", "header"), 14: ("MIT", "header")}
    assert got == want


def test_hundreds_of_templates_make_no_columns(spark):
    templates = {f"L{k}": f"licence number{k} grants right{k} and duty{k}" for k in range(400)}
    docs = spark.createDataFrame([(k, f"/d{k}/x", "code\n# " + templates[f"L{k * 7}"] + "\n" + "code " * 30) for k in range(20)], "doc_id long, path string, text string")
    got = {r.doc_id: r.licence for r in L.scan(docs, F.col("path"), L.fit(docs, templates)).collect()}
    assert got == {k: f"L{k * 7}" for k in range(20)}


def test_anchors_lose_no_match(spark):
    """Every unit with a cosine of LEAST or more has an anchor: all lines of single template words and of pairs."""
    model = L.Model(L.TEMPLATES, 1000, {"the": 900, "license": 40, "version": 80}, L.LEAST)
    import re

    for name, unit in ((n, u) for n, u in model.unit.items() if "#" not in n):
        for a in unit:
            for b in unit:
                x = {a: model.idf[a], b: model.idf[b]}
                norm = sum(v * v for v in x.values()) ** 0.5
                if sum(v * unit[w] for w, v in x.items()) / norm >= L.LEAST:
                    assert re.search(model.pattern(), f"{a} {b}"), (name, a, b)


def test_rows_are_judged_by_their_own_text(spark):
    """Null ids, one id with different texts, repeated rows, columns with the names that the operator uses."""
    rows = [(None, "/a/LICENSE", MIT), (1, "/b/LICENSE", MIT), (1, "/c/x", "plain words"), (2, "/a/y", "plain words"), (None, "/b/z", "plain words"), (3, "/d/LICENSE", GPL), (3, "/d/LICENSE", GPL), (None, "/d/LICENSE", MIT), (4, "/d/e/f", None)]
    docs = spark.createDataFrame([(*r, "z", "z") for r in rows], "doc_id long, path string, text string, row string, dir string").repartition(3)
    got = sorted(((r.doc_id, r.path, r.licence, r.how, r.from_doc) for r in L.scan(docs, F.col("path"), L.fit(docs)).collect()), key=str)
    want = [
        (None, "/a/LICENSE", "MIT", "file", None), (1, "/b/LICENSE", "MIT", "file", 1), (1, "/c/x", None, "none", None), (2, "/a/y", "MIT", "inherited", None), (None, "/b/z", "MIT", "inherited", 1),
        (3, "/d/LICENSE", "GPL-3.0", "file", 3), (3, "/d/LICENSE", "GPL-3.0", "file", 3), (None, "/d/LICENSE", "MIT", "file", None), (4, "/d/e/f", "GPL-3.0", "inherited", 3),
    ]
    assert got == sorted(want, key=str)


def test_spdx_expressions(spark):
    cases = {
        "(MIT OR Apache-2.0)": ("MIT OR Apache-2.0", ["Apache-2.0", "MIT"]), "Apache-2.0 OR MIT": ("Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]), "MIT */": ("MIT", ["MIT"]),
        "GPL-2.0-only WITH Classpath-exception-2.0": ("GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only"]), "MIT and more": ("MIT", ["MIT"]), "(MIT": ("MIT", ["MIT"]),
        "(MIT  AND\t(LGPL-2.1-or-later OR BSD-3-Clause))": ("(MIT AND (LGPL-2.1-or-later OR BSD-3-Clause))", ["BSD-3-Clause", "LGPL-2.1-or-later", "MIT"]), "OR MIT": ("OR", ["OR"]), "": (None, None),
        "(MIT OR ISC) AND (Zlib OR X11)": ("(MIT OR ISC) AND (Zlib OR X11)", ["ISC", "MIT", "X11", "Zlib"]), "LicenseRef-Own:1": ("LicenseRef-Own:1", ["LicenseRef-Own:1"]),
    }
    docs = spark.createDataFrame([(k, f"/d{k}/x", f"code\n// SPDX-License-Identifier: {tag}\nmore") for k, tag in enumerate(cases)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.licences) for r in L.scan(docs, F.col("path"), L.fit(docs)).collect()}
    assert got == dict(enumerate(cases.values()))


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(f"{COMMON}/GPL-3"), reason="no licence texts on this machine")
def test_a_folder_of_full_texts(spark, tmp_path):
    full = [n for n in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "Artistic") if os.path.exists(f"{COMMON}/{n}")]
    for n in full:
        shutil.copyfile(f"{COMMON}/{n}", tmp_path / f"{n}.txt")
    templates = {**L.TEMPLATES, **{f"{n}#full": t for n, t in L.texts(spark, str(tmp_path)).items()}}
    assert len(templates) == len(L.TEMPLATES) + len(full)
    read = lambda n: open(f"{COMMON}/{n}").read()  # noqa: E731, SIM115
    rows = [(k, f"/r{k}/COPYING", "Some Project\n\n" + wrapped(read(n), "", 60) if k % 2 else read(n)) for k, n in enumerate(full)]
    rows += [(100 + k, f"/r{k}/src/a.c", "int main() {}\n") for k in range(len(full))] + [(200, "/other/LICENSE", L.TEMPLATES["MIT#text"]), (201, "/other/prose", "a story about a license and a version of the world " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.licence, r.how) for r in L.scan(docs, F.col("path"), L.fit(docs, templates)).collect()}
    for k, n in enumerate(full):
        assert got[k] == (n, "file") and got[100 + k] == (n, "inherited")
    assert got[200] == ("MIT", "file") and got[201] == ("MIT", "inherited")


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, path string, text string")
    assert L.scan(docs, F.col("path"), L.fit(docs)).count() == 0
