"""Who speaks: what texts show, rules at their edges, and the fold over turns."""

from __future__ import annotations

import pytest

from cuelake.operators import turns
from cuelake.operators.ordered import fold

SCHEMA = "doc long, idx long, start_s double, end_s double, text string, voice array<double>"


def said(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r.asDict() for r in turns.signs(rows).orderBy("k").collect()]


def heard(spark, texts, gap=0.5, voices=None):
    rows = [(1, k, k * 4.0, k * 4.0 + 4.0 - gap, t, voices[k] if voices else None) for k, t in enumerate(texts)]
    return turns.speakers(spark.createDataFrame(rows, SCHEMA), voice="voice" if voices else None).orderBy("idx").collect()


def test_person(spark):
    texts = {"Men tayyorman.": 1, "Siz kelasizmi?": 2, "Ishga tushirdik.": 1, "U bog'ga bordi.": 0, "german dushman": 0, "Я знаю": 1, "Вы где": 2, "вы и я": 0, "": 0}
    assert [r["person"] for r in said(spark, *texts)] == list(texts.values())


@pytest.mark.parametrize(
    ("sign", "yes", "no"),
    [
        ("asks", ["Bormi?", "kelasizmi", "Shundaymi. ", "Yaxshimi !"], ["Bordi.", "mili", "mi?x"]),
        ("greets", ["Assalomu alaykum", "  Salom, ustoz", "Privet"], ["U salom berdi", "Va alaykum assalom"]),
        ("greets_back", ["Va alaykum assalom", "Ва алайкум ассалом"], ["Assalomu alaykum"]),
        ("answers", ["ha", "Ha, ha!", "Tushundim.", "Rahmat sizga"], ["halol", "ha men ham shunday", "kecha"]),
        ("takes_floor", ["Rahmat", "Xullas, ketdik", "Toʻxtang!", "Savol bor"], ["Men xullas", "ha"]),
        ("addresses", ["Kel, Anvar", "Кел, Анвар", "rahmat, ustoz", "keldi; O'tkir"], ["Men keldim, keyin ketdim", "Мен келдим, кейин кетдим", "akam", "Kel, A"]),
        ("ended", ["Ha.", "Bormi? ", "Ekan…"], ["Ha", "Ha,"]),
        ("runs_on", ["va keyin", "— ha", "…mi", " -ku"], ["Va", "1", ""]),
        ("blank", ["", " \n\t", None], ["."]),
    ],
)
def test_signs(spark, sign, yes, no):
    assert [r[sign] for r in said(spark, *yes, *no)] == [True] * len(yes) + [False] * len(no)


def test_boundaries(spark):
    rows = [(1, 0, 0.0, 2.0, "Salom.", None), (1, 1, 1.9, 4.0, "Keldi.", None), (1, 2, 6.5, 7.0, "Ketdi", None), (1, 3, 7.3, 8.0, "va qoldi.", None), (1, 4, 6.0, 8.5, "Bordi.", None)]
    got = turns.speakers(spark.createDataFrame(rows, SCHEMA)).orderBy("idx").collect()
    assert [r.cues for r in got] == [[], ["overlap:0.10s"], ["gap:2.5s"], ["continuation"], ["overlap:2.00s"]]
    assert [r.score for r in got] == [0.0, 0.9, 0.45, -2.2, 0.9]
    assert [r.speaker for r in got] == [1, 2, 2, 2, 1]


def test_speakers_alternate(spark):
    text = ["Assalomu alaykum, siz tayyormisiz?", "Va alaykum assalom, men tayyorman.", "Siz qachon keldingiz?", "Kecha keldim."]
    assert [r.speaker for r in heard(spark, text)] == [1, 2, 1, 2]


def test_cyrillic_interview_parts_as_its_latin_twin(spark):
    latin = ["Assalomu alaykum, xush kelibsiz.", "Va alaykum assalom, rahmat.", "Siz qachon boshladingiz?", "Men o'n yil oldin boshladim.", "Hozir nima qilyapsiz?", "Men yangi kitob yozyapman."]
    cyrillic = ["Ассалому алайкум, хуш келибсиз.", "Ва алайкум ассалом, раҳмат.", "Сиз қачон бошладингиз?", "Мен ўн йил олдин бошладим.", "Ҳозир нима қиляпсиз?", "Мен янги китоб ёзяпман."]
    parts = [[r.speaker for r in heard(spark, x)] for x in (latin, cyrillic)]
    assert parts[0] == parts[1] and set(parts[0]) == {1, 2}


def test_voices_name_and_bound_the_speakers(spark):
    voices = [[0.1 * 2**k, 0.02 * 2**k, 0.2 * 2**k] for k in range(12)]
    assert [r.speaker for r in heard(spark, ["Bir."] * 12, voices=voices)] == [*range(1, 9), 7, 8, 7, 8]
    same = [[0.1, 0.2, 0.3], [0.1, 0.2, 0.3], [0.5, 0.9, 0.9], None, [0.1, None, 0.3], [0.1, 0.2, 0.31]]
    assert [r.speaker for r in heard(spark, ["Bir."] * 6, voices=same)] == [1, 1, 2, 2, 2, 2]


def test_a_talk_in_small_batches_and_a_hot_one(spark):
    text = ["Siz keldingizmi?", "Ha, keldim.", "Siz qachon ketasiz?", "Men ertaga ketaman."]
    rows = [(d, k, k * 3.0, k * 3.0 + 2.9, text[k % 4], None) for d, n in ((None, 7), (1, 3000), (2, 5)) for k in range(n)]
    cues = spark.createDataFrame(rows, SCHEMA).repartition(5)
    whole = {(r.doc, r.idx): r.speaker for r in turns.speakers(cues).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        parts = {(r.doc, r.idx): r.speaker for r in turns.speakers(cues).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert whole == parts and len(whole) == len(rows)
    assert [whole[1, k] for k in range(4)] == [whole[2, k] for k in range(4)] == [whole[None, k] for k in range(4)]


def test_fold_keeps_rows_and_state(spark):
    rows = spark.createDataFrame([(k % 3, k, "x") for k in range(100)], "key int, at int, more string")
    got = fold(rows, ["key"], ["at"], list, lambda seen, r: (seen.append(r["at"]) or len(seen), sum(seen)), "n int, total long").collect()
    for r in got:
        own = [k for k in range(r.at + 1) if k % 3 == r.key]
        assert (r.n, r.total, r.more) == (len(own), sum(own), "x")
    assert len(got) == 100
    assert fold(rows.limit(0), ["key"], ["at"], list, lambda s, r: (1,), "n int").count() == 0
