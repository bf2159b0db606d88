"""Golden values of functions, parsers and serialisers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuelake.functions import glossary as G
from cuelake.functions import script as S
from cuelake.functions.timecode import ass_time, srt_time, vtt_time
from cuelake.operators import cutlaws, intervals, layout, ledger, signal
from cuelake.sources import sinks, timedtext
from cuelake.streaming import stateful


@pytest.mark.parametrize(
    ("cyr", "lat"), [("Ўзбек тили", "O'zbek tili"), ("ғалат ҳаво", "g'alat havo"), ("ущ", "ushch"), ("щу", "shchu"), ("Шветсия", "Shvetsiya"), ("ШВЕТСИЯ", "SHVETSIYA"), ("Я ЛЮБЛЮ ТЕБЯ", "YA LYUBLYU TEBYA"), ("ОҢ", "ONG")]
)
def test_cyrillic_to_latin(cyr, lat):
    assert S.transliterate(cyr) == lat


@pytest.mark.parametrize(("lat", "cyr"), [("O'zbek tili", "Ўзбек тили"), ("g'oz", "ғоз"), ("o'rta", "ўрта"), ("shch", "щ")])
def test_latin_to_cyrillic(lat, cyr):
    assert S.lat2cyr(lat) == cyr


def test_reformed():
    assert [S.to_reformed(x) for x in ("O'zbekiston", "g'oz", "Shvetsiya", "ma'no")] == ["Özbekiston", "ğoz", "Şvetsiya", "ma'no"]
    assert [S.from_reformed(x) for x in ("ŞAHAR", "ÖZBEK", "Şahar", "IŞ", "Ş")] == ["SHAHAR", "O'ZBEK", "Shahar", "ISH", "SH"]
    assert S.normalize("oʻgʻil") == "o'g'il" and S.normalize("gʼira") == "g'ira"
    assert S.to_official("O'zbek g'oz") == "Oʻzbek gʻoz"


def test_detected(spark):
    rows = spark.createDataFrame([("Привет hello мир world тест",), ("123 456 !!!",), (None,)], "t string").select(S.detected(F.col("t")).alias("d"), S.word_count(F.col("t")).alias("n"))
    got = [tuple(r.d) for r in rows.collect()]
    assert got[0][0] == "mixed" and got[1] == ("other", 0, 0, 0.0)


def test_times(spark):
    r = spark.createDataFrame([(3661.5,), (0.0,)], "s double").select(srt_time(F.col("s")), vtt_time(F.col("s")), ass_time(F.col("s"))).collect()
    assert tuple(r[0]) == ("01:01:01,500", "01:01:01.500", "1:01:01.50") and r[1][0] == "00:00:00,000"


SRT = "1\n00:00:01,000 --> 00:00:03,500\nSalom\ndunyo\n\n\nWEBVTT\n\n00:00:04,000 --> 00:00:05,5\ntext\n\n9\nno times\n"


def test_parse_srt(spark):
    rows = timedtext.parse_srt(spark.createDataFrame([(1, SRT), (2, ""), (3, None)], "id int, content string")).collect()
    assert [(r.id, r.idx, r.start, r.end, r.text) for r in rows] == [(1, 1, 1.0, 3.5, "Salom\ndunyo"), (1, 2, 4.0, 5.005, "text")]


def test_timed_lines(spark):
    text = "Bir ikki\n1-4|qo'lda\nuch to'rt besh olti yetti sakkiz to'qqiz o'n va yana ko'p so'z bor bu yerda"
    rows = timedtext.parse_timed_lines(spark.createDataFrame([(1, text)], "id int, content string"), "id").orderBy("pos").collect()
    assert [(r.start, r.end) for r in rows] == [(0.0, 2.0), (1.0, 4.0), (4.0, 10.0)] and rows[1].text == "qo'lda"


def test_asr_json(spark):
    files = [(1, '{"transcription":[{"offsets":{"from":500,"to":1500},"text":" a "},{"offsets":{"from":2,"to":3},"text":" "}]}'), (2, '{"segments":[{"start":0.5,"end":1.25,"text":"b"}]}'), (3, "{")]
    rows = timedtext.parse_asr_json(spark.createDataFrame(files, "id int, content string")).orderBy("id").collect()
    assert [(r.id, r.start, r.end, r.text) for r in rows] == [(1, 0.5, 1.5, "a"), (2, 0.5, 1.25, "b")]


def test_sinks(spark):
    words = [("bir", 0.0, 0.5), ("{ikki}", 0.5, 1.0)]
    df = spark.createDataFrame([(1, 0, 0.0, 1.0, "bir\nikki", words), (1, 1, 2.0, 3.0, "x", [])], "d int, i int, s double, e double, t string, w array<struct<w:string,s:double,e:double>>")
    assert sinks.to_srt(df, "d", "i", "s", "e", "t").first().body == "1\n00:00:00,000 --> 00:00:01,000\nbir\nikki\n\n2\n00:00:02,000 --> 00:00:03,000\nx\n"
    assert "<00:00:00.500>{ikki}" in sinks.words_to_vtt(df, "d", "i", "s", "e", "w").first().body
    assert "{\\kf50}bir {\\kf50}(ikki)" in sinks.words_to_ass(df, "d", "i", "s", "e", "w", "t").first().body
    assert "bir\\Nikki" in sinks.to_ass(df, "d", "i", "s", "e", "t", "t").first().body


@pytest.mark.parametrize(
    ("text", "k", "codes"),
    [("rejani hozir uchun yozdik", 2, ["postposition"]), ("uch soat keyin uddalandik", 2, ["postposition"]), ("matnni tekshirib, keyin esa", 2, []), ("u borib ketdi", 2, ["compound_verb"]), ("shuning uchun keldi", 1, ["postposition", "bind_right", "pair"]), ("ikki oy ichida tayyor", 1, ["numeral_unit"])],
)
def test_cut_laws(spark, text, k, codes):
    r = spark.createDataFrame([(text,)], "t string").select(cutlaws.judged(cutlaws.words_of(F.col("t"))).alias("j")).first()
    assert list(r.j[k - 1].codes) == codes


def test_grade(spark):
    assert [r[0] for r in spark.createDataFrame([(100.0,), (50.0,), (10.0,)], "s double").select(layout.grade(F.col("s"))).collect()] == ["A", "D", "F"]


def test_dub_schedule(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 2.0), (1, 2, 5.0, 1.0), (2, 0, 0.0, 3.0), (2, 1, 1.0, -1.0), (2, 2, 1.5, 1.0)], "d int, i int, s double, len double")
    got = intervals.packed_starts(rows, "d", "i", "s", "len").orderBy("d", "i").collect()
    assert [r.placed for r in got] == [0.0, 2.0, 5.0, 0.0, 3.0, 3.0]


def test_gate_and_pauses(spark):
    level = [0.3] * 50 + [0.001] * 50 + [0.3] * 50 + [0.001] * 25 + [0.3] * 75
    df = spark.createDataFrame([(1, f, x) for f, x in enumerate(level)], "tape int, f int, level double")
    gate = signal.gates(df)
    runs = signal.speech_runs(df, gate)
    assert sorted((r.first, r.last) for r in runs.collect()) == [(0, 49), (100, 149), (175, 249)]
    assert sorted((r.gs, r.ge) for r in signal.pauses(runs, gate).collect()) == [(1.0, 2.0), (3.0, 3.5)]


def test_frame_levels(spark):
    r = spark.createDataFrame([([0] * 320 + [16384] * 170,)], "p array<int>").select(signal.frame_levels(F.col("p"), 160).alias("l")).first()
    assert list(r.l) == [0.0, 0.0, 0.5]


def test_glossary():
    assert G.replace_terms("Pro plan, professional PRO", {"pro": "Про", "pro plan": "Тариф"}) == "Тариф, professional Про"
    text, marks = G.mask_terms("alpha beta", {"alpha": "A"})
    assert text == "⟦T0⟧ beta" and marks == {"⟦T0⟧": "A"}


def test_folds():
    assert stateful.admit_fold(np.array([0.0, 1.0, 2.0, 61.0]), 60.0, 2)[0] == [True, True, False, True]
    one = stateful.Breaker()
    told = [one.call(float(t), bool(bad)) for t, bad in zip([0, 1, 2, 3, 4, 5, 70, 71], [1, 1, 1, 1, 1, 0, 1, 0])]
    assert told == ["closed"] * 5 + ["open", "half_open", "open"]


def test_block_feed_is_invariant(spark, tmp_path):
    pcm = (np.sin(np.arange(1000) / 3) * 9000).astype("<i2").tobytes()
    out = []
    for k, size in enumerate((2000, 333)):
        src = tmp_path / f"in{k}"
        parts = [pcm[a : a + size] for a in range(0, len(pcm), size)]
        spark.createDataFrame(pd.DataFrame({"tape": 1, "block": range(len(parts)), "pcm": parts})).coalesce(1).write.parquet(str(src))
        stream = spark.readStream.schema("tape long, block long, pcm binary").parquet(str(src))
        q = stateful.feed_blocks(stream, 160).writeStream.format("memory").queryName(f"feed{k}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        out.append([(r.f, r.level) for r in spark.table(f"feed{k}").orderBy("f").collect()])
    assert out[0] == out[1] and len(out[0]) == 6


def test_admitted_stream(spark, tmp_path):
    src = str(tmp_path / "hits")
    spark.sql("SELECT id, 1L AS key, timestamp_seconds(id * 10) AS at FROM range(10)").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, key long, at timestamp").parquet(src)
    q = stateful.admitted_stream(stream, 60.0, 2).writeStream.format("memory").queryName("adm").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.id for r in spark.table("adm").filter("admitted").orderBy("id").collect()] == [0, 1, 6, 7]


def test_align_moves_shared_cuts_as_one():
    from cuelake.operators.alignment import align

    found = align([(0.0, 0.6), (0.6, 2.8), (2.8, 5.0)], [(1.0, 2.0), (3.0, 3.5)], 5.0)
    (a, b), (c, d), (e, f) = found.spans
    assert b == c == pytest.approx(1.03, abs=0.01) and d == e == pytest.approx(3.03, abs=0.01) and len(found.moves) == 4
    again = align(found.spans, [(1.0, 2.0), (3.0, 3.5)], 5.0)
    assert again.spans == found.spans and not again.moves


def test_align_long_tape():
    from cuelake.operators.alignment import align

    # every 6 s: voice 2.0, room 0.6, voice 2.0, room 1.4
    gaps = [g for k in range(150) for g in ((6 * k + 2.0, 6 * k + 2.6), (6 * k + 4.6, 6 * k + 6.0))]
    found = align([(6 * k + 1.85, 6 * k + 4.45) for k in range(150)], gaps, 900.0)
    assert len(found.moves) == 300 and max(abs(b - a) for *_, a, b in found.moves) == pytest.approx(0.18)
    assert found.spans[-1][0] == 896.03
    assert align([(0.0, 1.0)], [], 2.0).spans == [(0.0, 1.0)]


def test_repair_keeps_words_and_clearance(spark):
    from cuelake.operators import repair

    long = "Bu juda uzun gap bo'lib, uni bitta kartaga sig'dirib bo'lmaydi, chunki unda juda ko'p so'z bor va ular o'qilishi kerak, shuning uchun uni bo'lamiz."
    cues = [(0.0, 4.0, long), (4.0, 4.3, "Qisqa."), (9.0, 9.0, "Oxiri")]
    rows = [(1, k, *c) for k, c in enumerate(cues)] + [(2, 0, 0.0, 60.0, long), (3, 0, 1.0, 2.0, None)]
    got = repair.polished(spark.createDataFrame(rows, "doc long, idx long, start_s double, end_s double, text string")).orderBy("doc", "card").collect()
    assert {r.doc: r.mode for r in got} == {1: "sync", 2: "readability"}
    for doc in (1, 2):
        found = [r for r in got if r.doc == doc]
        assert " ".join(r.text for r in found).split() == " ".join(r[4] for r in rows if r[0] == doc).split()
        assert [r.card for r in found] == list(range(1, len(found) + 1))
        assert all(a.end + 0.08 <= b.start + 1e-9 and a.end - a.start >= 0.05 for a, b in zip(found, found[1:]))
        assert all(len(x) <= 42 for r in found for x in r.text.split("\n"))
    assert repair.wrapped("rejani hozir uchun yozdik va keyin ularni hammaga ko'rsatdik").count("\n") == 1
    assert repair.fault_count("hozir", "uchun") == 1 and repair.fault_count("tekshirib,", "keyin") == 0


def test_wav(spark, tmp_path):
    import wave

    from cuelake.sources.wav import read_levels

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.repeat(np.full(1600, 16384, dtype="<i2"), 2).tobytes())
    (tmp_path / "b.wav").write_bytes(b"OggS" + bytes(40))
    rows = {r.path[-5:]: r for r in read_levels(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["a.wav"].levels == [0.5] * 10 and rows["a.wav"].rate == 8000 and rows["b.wav"].code == "not_wav"


@pytest.mark.parametrize("to", ["latin", "new_latin", "cyrillic"])
def test_conversion_in_columns_is_that_of_whole_texts(spark, to):
    import random

    from cuelake.functions import script

    rng = random.Random(11)
    parts = ["o'", "O'", "G'", "g'", "sh", "Sh", "SH", "sH", "ch", "CH", "shch", "SHch", "ts", "Ts", "yo", "Yo", "YO", "yo'", "tshch", "ya", "s", "h", "c", "t", "y", "o", "w", "W", "ö", "Ö", "ş", "Ş", "Ç", "ğ", "é", "ß", "1", " ", ".", "’", "ʻ", "Ш", "щ", "Ё", "ъ", "é", "中"]
    texts = ["".join(rng.choice(parts if k % 3 else parts[:34]) for _ in range(rng.randint(0, 14))) for k in range(3000)] + [None, "", "TSHch", "shts"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", script.transliterated(F.col("t"), to).alias("u")).collect()
    for r in got:
        assert r.u == (None if texts[r.k] is None else script.transliterate(texts[r.k], to)), texts[r.k]


def test_styled_times_round_what_the_double_holds(spark):
    """17.415 lies under its half as a double, 0.005 above; their product with 100 is a half either way."""
    ms = [17415, 19915, 43915, 5, 15, 125, 375, 59995, 59999, 3_599_995, 77_415, *range(1005, 60000, 250)]
    rows = spark.createDataFrame([(x / 1000.0,) for x in ms], "s double").select("s", ass_time(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows] == [f"{int(r.s // 3600)}:{int(r.s % 3600 // 60):02d}:{r.s % 60:05.2f}" for r in rows]


def test_quota_left_rounds_halves_up(spark):
    """30 - 26.35 is less than 3.65 as a double, 240 - 26.35 is 213.65 exactly; both are halves."""
    from datetime import datetime

    users = spark.createDataFrame([(k, plan) for k, plan in enumerate(("free", "pro", "studio", "free"))], "id long, plan string")
    spent = ("26.35", "26.35", "599.95", "99.0")
    rows = spark.createDataFrame([(k, f"-{x}", datetime(2024, 1, 30, 5)) for k, x in enumerate(spent)], "user_id long, delta string, created_at timestamp")
    rows = rows.withColumn("delta", F.col("delta").cast("decimal(18,4)"))
    out = ledger.quota_left(users, rows, F.expr("DATE '2024-01-30'"), {"free": 30.0, "pro": 240.0, "studio": 600.0}).orderBy("user_id").collect()
    assert [r.left for r in out] == [3.7, 213.7, 0.1, 0.0]


def test_letters_by_replacement_are_those_by_pattern():
    """lat2cyr against reading from left to right, in every case of short texts."""
    from itertools import product

    found = S._pattern(S.LATIN)

    def one(m):
        to = S.LATIN[m[0].lower()]
        return to.upper() if m[0][:1].isupper() else to

    for n in (1, 2, 3, 4):
        for t in map("".join, product("tsSChHyo'g" if n > 3 else "tsSchHyYoO'gGau", repeat=n)):
            assert S.lat2cyr(t) == found.sub(one, t)
