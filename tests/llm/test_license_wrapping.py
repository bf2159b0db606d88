"""A licence is found however its text is wrapped, with or without notices."""

from __future__ import annotations

import textwrap
from pathlib import Path

import pytest

from cuelake.llm import licenses
from cuelake.llm.license_texts import DIGESTS

#: Where this system keeps whole licence texts, by the names of our ids.
TEXTS = Path("/usr/share/common-licenses")
FILES = {"Artistic-1.0-Perl": "Artistic", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3"}

NOTICES = ("", "Copyright (c) 2020 A. Person\n\n", "// Copyright 2019-2021 A. Person\n", " * © 2020 A. Person. All rights reserved.\n", "# Copyright © A. Person\n")


def test_every_wrapping(spark):
    rows = []
    for name, text in licenses.KNOWN:
        for width in (*range(40, 121), 10_000):
            wrapped = "\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
            rows.append((name, NOTICES[width % len(NOTICES)] + wrapped))
    df = spark.createDataFrame(rows, "want string, text string")
    got = licenses.scan(df, licenses.known_digests(spark))
    assert got.filter("license_id is null or license_id <> want").count() == 0


def test_body_lines_stay(spark):
    df = spark.createDataFrame([("copyright holders be liable",), ("Copyright 2020 X",), ("(c) the third clause",)], "text string")
    assert [r[0].strip() for r in df.select(licenses.canonical(df.text)).collect()] == ["copyright holders be liable", "", "c the third clause"]


@pytest.mark.skipif(not TEXTS.is_dir(), reason="the system keeps no licence texts")
def test_whole_long_licences(spark):
    rows = []
    for name, _ in DIGESTS:
        path = TEXTS / FILES.get(name, name)
        if path.is_file():
            text = path.read_text(encoding="utf-8")
            rows += [(name, text), (name, "/* Copyright (c) 2021 Someone */\n" + text.upper()), (None, text + " and more")]
    assert rows
    got = licenses.scan(spark.createDataFrame(rows, "want string, text string").withColumn("_digest", licenses.F.lit("own")), licenses.known_digests(spark)).collect()
    assert all(r.license_id == r.want and r._digest == "own" for r in got)


def test_long_lines_of_marks(spark):
    name, text = licenses.KNOWN[0]
    marks = ["- ", "# ", "*\t", "/ * ", "--- ", ">", "% ; "]
    rows = [(k, f"a\n{m * 100_000}\nb") for k, m in enumerate(marks)]
    rows += [(100 + k, f"{m * 100_000}Copyright 2020 A. Person\n{text}") for k, m in enumerate(marks)]
    got = {r.n: r for r in licenses.scan(spark.createDataFrame(rows, "n int, text string"), licenses.known_digests(spark)).collect()}
    assert len({got[k].digest for k in range(len(marks))}) == 1  # "a b" is left
    assert all(got[100 + k].license_id == name for k in range(len(marks)))
