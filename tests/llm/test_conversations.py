"""Conversation repair against a plain recurrence over all edits, on odd rows, in small windows and over many partitions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cuelake.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, gone string, at string, kind string, digest string"


def rows(seed=5, convs=120):
    rng = random.Random(seed)
    lines = ["Yes.", "No", "Why?\n", "", " \t", "Stop! ", "the end. ", "a. b", "Größe.", "x" * 3000 + "."]
    out = []
    for c in range(convs):
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(0, 5)
        roles = [rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.25 else r for r in roles]
        out += [(c, t * rng.choice([1, 1, 1, 2]), r, rng.choice(lines) if rng.random() < 0.5 else f"Line {rng.randint(0, 9)}.") for t, r in enumerate(roles)]
    out += [(None, 0, "user", "No id."), (None, None, None, None), (None, 1, "assistant", "None.")]
    out += [(500, None, "user", "No turn."), (500, None, "assistant", "None."), (501, 3, None, None), (502, -2, "user", "Below."), (502, 4, "assistant", "Above.")]
    out += [(600, 7, "user", "Same."), (600, 7, "user", "Same."), (600, 7, "assistant", "Same."), (600, 7, "assistant", "Same.")]
    out += [(700, t, ["user", "assistant", "user", "system"][t % 4], f"Hot {t % 50}{'.' if t % 3 else ''}") for t in range(400)]
    return out


def hurt(table):
    out = defaultdict(list)
    for c, t, role, text in table:
        out[c]
        say = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        role, text = say(role), say(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def in_order(table):
    return sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


PATTERN = {0: "su", 1: "u", 2: "a", 3: "u"}


def brute(table):
    table = in_order(table)
    seen, faults = set(), []
    for _, role, text in table:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = lambda q, x: 1 if x == "s" else 2 if x == "u" else 3

    def more(have):
        """One more inserted row, twice; a third never pays."""
        for _ in range(2):
            for q, (cost, audit, lines) in list(have.items()):
                for x in PATTERN[q]:
                    if x != "s":
                        one = (cost + 5, audit + "I", [*lines, ("user" if x == "u" else "assistant") + ":"])
                        have[step(q, x)] = min(have.get(step(q, x), one), one, key=lambda v: v[:2])
        return have

    best = more({0: (0, "", [])})
    for (_, role, text), fault in zip(table, faults):
        after = {}
        for q, (cost, audit, lines) in best.items():
            ways = [(q, (cost + 2, audit + "D", lines))]
            if fault not in ("b", "d"):
                extra = 5 if fault else 0
                for x in PATTERN[q]:
                    if role[:1] == x:
                        ways.append((step(q, x), (cost + extra, audit + "K", [*lines, f"{role}:{text}"])))
                    if x != "s":
                        ways.append((step(q, x), (cost + extra + 1, audit + "R", [*lines, f"{'user' if x == 'u' else 'assistant'}:{text}"])))
            for q2, way in ways:
                after[q2] = min(after.get(q2, way), way, key=lambda v: v[:2])
        best = more(after)
    cost, audit, lines = min((best[q] for q in (0, 3) if q in best), key=lambda v: v[:2])
    turns = [t for t, _, _ in table if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(table, table[1:]))
    return (gaps, *(faults.count(x) for x in "bdt"), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def write(spark, folder, table, parts=4):
    spark.createDataFrame([(*r, *"wxyz") for r in table], SCHEMA).repartition(parts).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("window, parts", [(512, "4"), (3, "40"), (1, "3")])
def test_query(spark, tmp_path, monkeypatch, window, parts):
    monkeypatch.setattr(conversations, "WINDOW", window)
    table = rows()
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = conversations.op11_conversations(spark, write(spark, tmp_path, table)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = Counter((c, *brute(t)[0]) for c, t in hurt(table).items())
    assert Counter(tuple(r) for r in got) == want
    assert {r.audit for r in got if "I" in r.audit or "R" in r.audit}


def test_repaired_rows(spark):
    table = [r for r in rows(9, 40)]
    got = conversations.repaired(spark.createDataFrame([(*r, *"wxyz") for r in table], SCHEMA)).collect()
    say = lambda x: " " if x is None else x
    by = defaultdict(list)
    for c, t, role, text in table:
        by[c].append((t, say(role), say(text)))
    for c, t in by.items():
        lines = sorted((r.place, f"{r.role}:{r.text}") for r in got if r.conv_id == c)
        assert [x for _, x in lines] == brute(t)[1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for _, x in lines))


def test_search_against_all_short_edits():
    """The cost is that of the cheapest of all edit strings of up to two rows more than there are."""
    rng = random.Random(2)
    for _ in range(60):
        some = [(rng.choice("suax"), rng.choice([None, None, None, "truncated", "blank"])) for _ in range(rng.randint(0, 4))]
        best = None
        for n in range(len(some), len(some) + 3):
            for audit in map("".join, itertools.product("DIKR", repeat=n)):
                if sum(e != "I" for e in audit) != len(some):
                    continue
                state, cost, left = 0, 0, iter(some)
                for e in audit:
                    own, fault = next(left) if e != "I" else (None, None)
                    wanted = [x for x in PATTERN[state] if x != "s"][0]
                    if e == "D":
                        cost += 2
                        continue
                    if fault == "blank" or e == "K" and own not in PATTERN[state]:
                        break
                    cost += {"I": 5, "K": 0, "R": 1}[e] + (5 if fault else 0)
                    x = own if e == "K" else wanted
                    state = 1 if x == "s" else 2 if x == "u" else 3
                else:
                    if state in (0, 3):
                        best = min(best or (cost, audit), (cost, audit))
        assert min(conversations.search(some, 0, (0, 3)).values()) == best


def test_empty_table(spark, tmp_path):
    assert conversations.op11_conversations(spark, write(spark, tmp_path, [], 1)).count() == 0
    assert conversations.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
