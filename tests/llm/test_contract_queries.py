"""The queries of operators 4, 5, 6, 7 and 9 against brute force written from their contracts, on tables read from files."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash

from cuelake.llm import packing, quality_model, quality_rules, simhash, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(17)
    vocab = [f"w{k}" for k in range(200)] + ["Été", "it's", "A-b", "ẞ", "中文"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(k, f"{make(rng.randint(1, 150))}\n{make(rng.randint(1, 40))}") for k in range(150)]
    rows += [(200, None), (201, ""), (202, "\t \n"), (203, make(9000)), (204, rows[3][1]), (3, make(5)), (None, make(60)), (205, rows[4][1].upper()), (206, make(2)), (207, "w1")]
    rows += [(300 + k, rows[7][1] + " " + rng.choice(vocab)) for k in range(12)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(texts(), "doc_id long, text string").repartition(3).write.parquet(str(out / "documents.parquet"))
    return str(out)


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in texts():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            raw = b"".join(x.to_bytes(4, "little") for x in part)
            want[i, piece, start, len(part), zlib.crc32(raw)] += 1
    rows = packing.op4_packing(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(places) == -(-total // 4096)


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_simhash(spark, folder):
    rows = texts()
    fps = [brute_fingerprint(t) for _, t in rows]
    assert xxhash.xxh64(b"", seed=0).intdigest() == 0xEF46DB3751D8E999  # the digest's published value
    above = list(range(len(rows)))

    def root(k):
        while above[k] != k:
            k = above[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                above[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    want = Counter((i, f"{fps[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.op6_simhash(spark, folder).select("doc_id", "fingerprint", "component_id").collect()) == want
    assert any(n > 1 for n in Counter(least.values()).values()) or len(least) < len(rows)


BAD = {
    "mean_word_length": "x y " * 40 + " ".join(f"a{k}" for k in range(9)) + " b c d e f g h i",
    "symbols_per_word": " ".join(f"{'#$' if k % 3 else ''}some{k}" for k in range(60)),
    "exclamations_per_word": " ".join(f"wow{k}!!" for k in range(60)),
    "upper_case_share": " ".join(f"SHOUT{chr(65 + k % 26)}{chr(65 + k // 26)}" for k in range(60)),
    "duplicate_line_share": "\n".join(["alpha beta"] * 30) + "\n" + "\n".join(f"line{k} of{k} its{k} own{k} kind{k} and{k} more{k} words{k} to{k} come{k}" for k in range(12)),
    "one_word_share": " ".join(f"the word{k}" for k in range(60)).replace(" word1 ", " the "),
    "one_pair_share": " ".join(f"of the thing{k} once{k}" if k % 2 else "of the" for k in range(60)),
    "letterless_word_share": " ".join(f"{k * 37} name{k}" for k in range(60)),
    "list_line_share": "\n".join(f"- entry{k} of{k} list{k} number{k}" for k in range(20)),
    "broken_line_share": "\n".join(f"entry{k} of{k} list{k} goes{k} on..." for k in range(20)),
}


def brute_counts(t):
    w = WORD.findall(t or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_quality_rules(spark, tmp_path):
    rows = texts() + [(1000 + k, t) for k, t in enumerate(BAD.values())]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = quality_rules.op9_quality_rules(spark, str(tmp_path)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *brute_counts(t)) for i, t in rows)
    assert not any(r.kept for r in got if r.base_failed)
    by = {r.doc_id: r for r in got}
    for k, name in enumerate(BAD):
        failing = {r.name for r in quality_rules.RULES if r.fails(quality_rules.Features(BAD[name]))}
        assert name in failing, name
        assert not by[1000 + k].kept
    assert sum(by[k].kept for k in range(150)) == sum(not brute_counts(t)[5] for i, t in rows[:150] if i != 3) + (not by[3].base_failed and by[3].kept)


def test_the_order_of_rules_never_changes_the_result(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = lambda: sorted((str(r.doc_id), r.n_words, r.kept) for r in quality_rules.judge(docs).collect())
    first = kept()
    monkeypatch.setattr(quality_rules, "order_rules", lambda measured, rules: list(reversed(rules)))
    assert kept() == first


@pytest.mark.parametrize("query, column, modulus, rest, cut", [(quality_model.op5_quality, "quality", 5, 0, 0.3), (toxicity.op7_toxicity, "toxic", 3, 1, 0.7)])
def test_classifiers(spark, tmp_path, query, column, modulus, rest, cut):
    rng = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "l")]
    rows, labels = [], []
    for k in range(500):
        t = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        bad = k % 5 == 0
        text = " ".join(t[:3] * 15) if bad and column == "quality" else " ".join([*t, rng.choice(["zorgon", "plimf"])] if bad else t)
        rows.append((k, text, "xx" if bad else "yy", "s"))
        if k % 4:
            labels.append((k, int(not bad), int(bad)))
    rows += [(900, None, "xx", "s"), (901, "", "yy", "s"), (None, rows[5][1], "xx", None), (5, rows[5][1], "zz", "t")]

    def run(folder, labels, lang):
        spark.createDataFrame([(i, t, lang or x, s) for i, t, x, s in rows], "doc_id long, text string, lang string, source string").repartition(2).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        return query(spark, str(folder)).collect()

    got = run(tmp_path / "a", labels, None)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % modulus == rest
    for r in got:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    truth = {i: dict(quality=q, toxic=t)[column] for i, q, t in labels}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert sum(right) >= 0.9 * len(right) > 0
    # labels of held-out rows, lang and source have no part in any score
    flipped = [(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    again = run(tmp_path / "b", flipped, "same")
    one, two = (sorted((str(r.doc_id), r.score) for r in x) for x in (got, again))
    assert [i for i, _ in one] == [i for i, _ in two]
    assert [x for _, x in one] == pytest.approx([x for _, x in two], abs=1e-6)
