import math
import re
from collections import Counter

import pytest

from slopeweave.llm import licenses


def plain(files, templates=licenses.TEMPLATES, least=licenses.LEAST_COSINE):
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t))
    vocabulary = {w for _, t in templates for w in cut(t)}
    df = Counter(w for _, _, t in files for w in set(cut(t or "")) & vocabulary)
    idf = {w: math.log((1 + len(files)) / (1 + df[w])) + 1 for w in vocabulary}
    other = sorted(idf.values())
    other = (other[(len(other) - 1) // 2] + other[len(other) // 2]) / 2
    vector = lambda t: {w: n * idf.get(w, other) for w, n in Counter(cut(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    marks = [(n, vector(t)) for n, t in templates]
    own = []
    for d, p, t in files:
        best = (None, None)
        for unit in [*(t or "").split("\n"), *re.split(r"\n(?:[^0-9A-Za-z\x80-\U0010FFFF\n]*\n)+", t or "")]:
            v = vector(unit)
            for name, m in marks if v else []:
                c = sum(x * v.get(w, 0) for w, x in m.items()) / norm(v) / norm(m)
                if c >= least and (best[1] is None or c > best[1] + 1e-12):
                    best = (name, c)
        own.append((d, p, *best))
    given = {}
    for d, p, name, c in own:
        if name and p is not None and re.match(licenses.LICENSE_FILE, p.rpartition("/")[2]):
            key = p.rpartition("/")[0]
            given[key] = min(given.get(key, (0, "")), (-c, name))
    out = []
    for d, p, name, c in own:
        up = None
        if name is None and p is not None:
            at = p.rpartition("/")[0]
            while True:
                if at in given:
                    up, name = at, given[at][1]
                    break
                if not at:
                    break
                at = at.rpartition("/")[0]
        out.append((str(d), str(p), str(name), None if c is None else round(c, 6), up))
    return sorted(out, key=str)


def test_own_and_inherited_licenses(spark):
    text = "some words here\nLicensed under the Apache License, Version 2.0.\nmore"
    long = licenses.TEMPLATES[2][1]
    files = [(1, "a/b/x.txt", "plain words"), (2, "a/LICENSE", "Released under the MIT License."), (3, "a/b/c/y.py", text), (4, "a/b/c/z.py", ""), (5, "q/z.py", None),
             (6, "a/b/COPYING.txt", "This work is licensed under the GNU General\nPublic License, version 3."), (7, "a/b/c/d/e/f.py", "x"), (8, None, "y"), (None, "a/g", "z"),
             (9, None, text.upper()), (10, "top.txt", "t"), (11, "a/h", "h"), (11, "a/h", "h"), (12, "m/NOTICE", long[:70] + "\n" + long[70:]), (13, "m/n/o", "w " * 300_000),
             (14, "m/k", "the license of the work is not here"), (15, "r/LICENSE", "no license text"), (16, "r/s", "v"), (17, "a/LICENCE-2", "Licensed under CC BY-NC 4.0, " + "and more words " * 1),
             (18, "j/l", "Licensed under CC BY-NC 4.0"), (19, "j/p", "licensed*** under### cc%%% by-nc$$$ 4.0")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").repartition(3)
    got = sorted(((str(r.doc_id), str(r.path), str(r.license), None if r.score is None else round(r.score, 6), r.inherited_from) for r in licenses.scan(df).collect()), key=str)
    assert got == plain(files)
    assert {g[2] for g in got} >= {"MIT", "Apache-2.0", "GPL-3.0-only", "CC-BY-NC-4.0"}
    assert licenses.scan(df.limit(0)).count() == 0


def test_a_license_at_the_root(spark):
    files = [(1, "LICENSE", "Released under the MIT License"), (2, "a/b/c", "x"), (3, "d", "y")]
    got = licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    assert {(r.doc_id, r.license, r.inherited_from) for r in got} == {(1, "MIT", None), (2, "MIT", ""), (3, "MIT", "")}


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    files = [(r.doc_id, f"{r.source}/{r.doc_id % 7}/{'LICENSE' if r.doc_id % 5 == 0 else r.doc_id}", r.text) for r in docs.collect()]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").repartition(3)
    got = sorted(((str(r.doc_id), str(r.path), str(r.license), None if r.score is None else round(r.score, 6), r.inherited_from) for r in licenses.scan(df).collect()), key=str)
    assert got == plain(files) and any(g[2] != "None" for g in got)
