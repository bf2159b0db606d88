"""op2_lines against brute force: classes, links and what stays, with a group of lines that all differ by one sign."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelake.llm import lines

LAST = (1 << 63) - 1


def table():
    rng = random.Random(21)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n)).strip() or "x"
    rows = []
    for k in range(25):
        base = make(rng.choice((18, 19, 20, 21, 22, 40, 90)))
        near = list(base)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(near))
            near[at : at + 1] = rng.choice(("", "q", near[at] + "z"))
        rows.append((k, f"{base}\n{make(30)}\n \n{''.join(near)}\nshort\n{base}"))
    head = make(60)
    rows += [(100 + k, f"{head} number {k:03d} of the group {head[:20]}\n{make(25)}") for k in range(290)]
    rows += [(3, rows[4][1]), (3, rows[5][1]), (None, rows[6][1]), (None, make(40)), (7, rows[7][1]), (900, None), (901, ""), (902, "\n\n"), (903, make(20000))]
    return rows


def brute(rows):
    places = {(LAST if i is None else i, t, k): x for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")}
    distinct = sorted(set(places.values()))
    above, links = {x: x for x in distinct}, Counter()

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            if abs(len(a) - len(b)) <= 2 and min(len(a), len(b)) >= 20 and lines.within_edits(a, b, 2):
                links[a] += 1
                links[b] += 1
                above[root(a)] = root(b)
    return places, links, root


@pytest.mark.parametrize("cell", [16, 512])
def test_query(spark, tmp_path, cell, monkeypatch):
    rows = table()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    keyed = lines.line_classes
    monkeypatch.setattr(lines, "line_classes", lambda docs: keyed(docs, cell=cell))
    got = lines.op2_lines(spark, str(tmp_path)).collect()
    places, links, root = brute(rows)
    assert max(links.values()) >= 120
    many = Counter()
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\n\x0b\x0c\r"):
                many[i, k] += 1
    assert Counter((r.doc_id, r.line) for r in got) == many
    # where an id has one text, the line of a row is known, so links and classes can be compared
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(t)
    line = lambda i, k: next(iter(texts[i])).split("\n")[k]
    first = {}
    for (i, _, k), x in places.items():
        first[root(x)] = min(first.get(root(x), (LAST, LAST)), (i, k))
    for r in got:
        if len(texts[r.doc_id]) > 1:
            continue
        x = line(r.doc_id, r.line)
        i, k = first[root(x)]
        assert r.n_links == links[x]
        assert r.class_doc_id == (None if i == LAST else i)
        if len(texts[r.class_doc_id]) == 1:
            assert r.class_line == k and r.kept == ((r.doc_id, r.line) == (r.class_doc_id, k))


def test_entries_grow_with_lines_not_pairs(spark):
    docs = spark.createDataFrame([(k, f"the same long beginning of every line, then {k:04d} and its end") for k in range(600)], "doc_id long, text string")
    rows = lines._keyed(docs)
    entries = lines.candidates(rows, 2, 20)
    assert entries.count() <= 600 * 24
    texts = rows.select(F.col("text")).distinct()
    assert texts.count() == 600
    _, classes = lines.line_classes(docs)
    out = classes.collect()
    assert len(out) == 600 and len({r.first for r in out}) == 1


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "one line that is long enough", "a", 5), (2, "one line that is long enuogh", "b", 6)], "doc_id long, text string, _d string, _kept int")
    got = {r.doc_id: r for r in lines.dedup_lines(docs.withColumn("_t", F.lit("t")).withColumn("_doc", F.lit(1)).withColumn("_tkey", F.lit(2))).collect()}
    assert got[1]._d == "a" and got[2]._kept == 6 and got[1]._t == "t" and got[1].text and not got[2].text
