"""Known licenses in other wrappings, comments and with notices, and the scan against its SQL."""

import textwrap

import duckdb
import pytest

from tessera.llm import licenses

FILES = {p.stem: p.read_text(encoding="utf-8") for p in (licenses.Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
OWNER = "Copyright (c) 2019-2021 A. Body and Others <a@b.example>"


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in text.split("\n\n"))


def cases():
    for name, text in FILES.items():
        yield from ((name, wrapped(text, width)) for width in range(50, 101, 5 if len(text) > 8000 else 1))
        yield name, " ".join(text.split())
        yield name, f"{OWNER} " + " ".join(text.split())
        yield name, "\n".join("# " + x for x in [OWNER, "", *wrapped(text, 72).split("\n")])
        yield name, "/*\n" + "\n".join(" * " + x for x in wrapped(text, 66).split("\n")) + "\n */"
        yield name, "// " + "\n// ".join(wrapped(text, 60).split("\n"))
        yield None, wrapped(text, 70) + "\n\nThis text goes on with terms of its own."
        yield None, "Some prose before.\n" + text
    yield "MIT", f"The MIT License (MIT)\n\n{OWNER}\n© 2001 by C. Body\n\n" + FILES["MIT"]
    yield "BSD-3-Clause", "BSD 3-Clause License All rights reserved. " + FILES["BSD-3-Clause"]
    yield "ISC", FILES["ISC"] + "\n\n" + OWNER
    yield None, "Copyright is a word that begins a line.\nCopyright (c) 2020 may do so as well."
    yield None, None
    yield None, ""


def test_whole_texts_in_any_wrapping(spark):
    known = list(cases())
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(known)], "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.license for r in licenses.scan(docs, licenses.notices() + licenses.whole_texts()).collect()}
    assert {i: (n, (t or "")[:60]) for i, (n, t) in enumerate(known) if found[i] != n} == {}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("licenses"))
    texts = [t for n, t in cases() if n in (None, "MIT", "ISC", "GPL-2.0")][:150]
    lines = ["first\nReleased under the MIT License.\nReleased under the MIT License.\n# Licensed under Apache 2.0 License\nlast", "x\n  - mit LICENCE!\n"]
    rows = [(i, t, 1, "k") for i, t in enumerate([*texts, *lines, *lines, None])] + [(None, lines[0], 1, "k"), (7, lines[0], 1, "k"), (7, lines[0], 1, "k")]
    spark.createDataFrame(rows, "doc_id long, text string, digest int, _key string").write.parquet(f"{d}/documents.parquet")
    return d


def test_scan_equals_sql(spark, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    wanted = con.sql(licenses.sql())
    names = wanted.columns
    found = [tuple(r[c] for c in names) for r in licenses.op9_license_digests(spark, folder).collect()]
    assert sorted(map(str, found)) == sorted(map(str, wanted.fetchall()))
    rows = [dict(zip(names, r, strict=True)) for r in found]
    assert sum(r["license"] is not None for r in rows) > 50
    assert {(r["n_license_lines"], r["line_licenses"]) for r in rows if r["doc_id"] in (None, 7) and r["n_license_lines"]} == {(3, "Apache-2.0,MIT")}
