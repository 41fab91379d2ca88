"""Licence scan: canonical forms, joins, parity with its SQL."""

import re

import duckdb
import pytest

from churnwise.llm import license_scan as ls
from churnwise.llm.license_texts import MIT
from churnwise.llm.queries import QUERIES, SQL
from conftest import SF_SMALL

VARIANT = "MIT LICENCE\n\nCopyright (c) 2020 Some One\n(C) 2021 Other\n© 2022 Third\n\n" + MIT.replace(
    "sublicense", "sub-license").replace('"', "''").replace(" ", "  ").replace("\n", "\n\n")


def scan(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, scope string, digest string")
    return sorted((r["doc_id"], r["scope"], r["license_id"], r["matches"])
                  for r in ls.scan(df, ls.known_licenses(spark)).collect() if r["doc_id"] is not None)


def test_entire_texts_only(spark):
    rows = [(1, MIT), (2, VARIANT), (3, MIT + " and more"), (4, "some text\nReleased under the MIT Licence!\nmore"),
            (5, None), (6, ""), (7, "we say: Released under the MIT License. often"), (8, "Released under the MIT License"),
            (9, "released under the mit license\n" * 3), (10, "x " * 100000), (9, "Licensed under CC BY-NC 4.0")]
    assert scan(spark, rows) == [
        (1, "document", "MIT", 1), (2, "document", "MIT", 1), (4, "line", "MIT", 1),
        (8, "document", "MIT", 1), (8, "line", "MIT", 1), (9, "document", "CC-BY-NC-4.0", 1), (9, "line", "CC-BY-NC-4.0", 1),
        (9, "line", "MIT", 3)]
    assert scan(spark, []) == []


def test_large_known_table_is_joined(spark, monkeypatch):
    monkeypatch.setattr(ls, "KNOWN_BROADCAST_ROWS", 0)
    assert scan(spark, [(1, MIT)]) == [(1, "document", "MIT", 1)]


@pytest.mark.parametrize("own", [True, False])
def test_same_as_sql(spark, own):
    con = duckdb.connect()
    if own:
        rows = [(1, MIT), (2, VARIANT), (3, None), (4, "a\nSPDX-License-Identifier: MIT\n\n(c) b"), (5, ""), (6, "É (c)")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        got = ls.scan(df, ls.known_licenses(spark)).collect()
    else:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
        got = QUERIES["op2_license_scan"](spark, SF_SMALL).collect()
    want = con.execute(SQL["op2_license_scan"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert want


def test_whole_long_texts_and_rights_reserved(spark):
    from churnwise.llm.license_texts import BSD_3, KNOWN
    text = {i: t for i, t in reversed(KNOWN)}
    ids = ["Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense"]
    longest = {i: max((t for k, t in KNOWN if k == i), key=len) for i in ids}
    assert all(len(longest[i]) > 1000 for i in ids) and set(ids) <= set(text)
    rows = list(enumerate(longest.values())) + [
        (20, "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + BSD_3), (21, "All Rights Reserved\n" + MIT),
        (22, longest["Apache-2.0"].split("APPENDIX")[0].upper()), (23, longest["GPL-3.0-only"] + "more"),
        (24, "All rights reserved.")]
    want = [(n, "document", i, 1) for n, i in enumerate(ids)] + [
        (20, "document", "BSD-3-Clause", 1), (21, "document", "MIT", 1), (22, "document", "Apache-2.0", 1)]
    assert [r for r in scan(spark, rows) if r[1] == "document"] == want


# The lines of the known texts that may go, by hand: every one names a holder or a placeholder.
NOTICES = re.compile(r"copyright \(c\) +([0-9]{4}(, ?[0-9]{4})*|<year>|year|19yy) .*|copyright \[yyyy\] .*|copyright \(c\)  year .*"
                     r"|[_.]+ all rights reserved[.]?")


def plain(text):
    """Own normaliser: what is left of each line, with the lines that are notices left out."""
    from churnwise.llm.license_texts import EQUIVALENT
    out = []
    for line in text.lower().split("\n"):
        if NOTICES.fullmatch(line.strip()):
            continue
        for pattern, word in EQUIVALENT:
            line = re.sub(pattern, word, line)
        out.append(" ".join(re.findall("[a-z0-9]+", line)))
    return " ".join(x for x in out if x)


def test_only_notices_go(spark):
    """The canonical form of every known text is the plain one: no line of terms is left out."""
    from churnwise.llm.license_texts import KNOWN
    df = spark.createDataFrame(KNOWN, "id string, text string")
    got = df.select("text", ls.canonical_text(ls.F.col("text")).alias("c")).collect()
    assert len(got) == len(KNOWN)
    for r in got:
        assert r["c"] == plain(r["text"])


@pytest.mark.parametrize("name", ["Apache-2.0", "MPL-2.0", "MPL-1.1", "BSD-3-Clause", "GFDL-1.3-only"])
def test_altered_lines_never_match(spark, name):
    from churnwise.llm.license_texts import KNOWN
    text = max((t for i, t in KNOWN if i == name), key=len)
    lines = text.split("\n")
    rows = [(n, "\n".join([*lines[:n], line + " not at all", *lines[n + 1:]])) for n, line in enumerate(lines)
            if plain(line)]
    rows += [(10_000 + n, "\n".join([*lines[:n], *lines[n + 1:]])) for n, line in enumerate(lines) if plain(line)]
    assert len(rows) > 10
    assert [r for r in scan(spark, rows) if r[1] == "document" and r[0] not in ends(text, rows)] == []


def ends(text, rows):
    """Rows that are another known text: some texts are known with and without what follows their terms."""
    from churnwise.llm.license_texts import KNOWN
    known = {plain(t) for _, t in KNOWN}
    return {n for n, t in rows if plain(t) in known}


def test_altered_apache_clause(spark):
    from churnwise.llm.license_texts import KNOWN
    text = max((t for i, t in KNOWN if i == "Apache-2.0"), key=len)
    other = re.sub(r"\(c\) You must retain, in the Source form of any Derivative Works",
                   "(c) You need not keep anything at all and may remove", text)
    assert other != text
    assert [r for r in scan(spark, [(1, other), (2, text)]) if r[1] == "document"] == [(2, "document", "Apache-2.0", 1)]


def test_notices(spark):
    lines = ["Copyright 2019 The Authors", "(c) 2019-2021 X", "© 2001 Y, Inc. All rights reserved.", "# Copyright (C) Some Company.",
             "Copyright [yyyy] [name of copyright owner]", "All rights reserved."]
    terms = ["(c) You must retain", "copyright license to reproduce", "copyright holder, and you cure", "(c) under Patent Claims",
             "Copyright (c) 2019" + " and you lose all rights" * 20, "copyright 20 years", "all rights reserved to you"]
    df = spark.createDataFrame([(x,) for x in lines + terms], "text string")
    got = [r["n"] for r in df.select(ls.F.size(ls.canonical_lines(ls.F.col("text"))).alias("n")).collect()]
    assert got == [0] * len(lines) + [1] * len(terms)
