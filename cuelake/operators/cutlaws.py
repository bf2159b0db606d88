"""Where a line may be cut: five laws over the two words at a junction.

All of it is column expressions over arrays inside the row, so a text of any length needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word classes of the laws.
APOSTROPHES = "ʻ‘’ʼ`"
POSTPOSITIONS = """uchun bilan haqida gacha tufayli orqali karshi oldidan orqasidan ichidan tashqari nisbatan markazida
    atroflida chekkacha degan deb qarab bog'liq""".split()
AMBIGUOUS = "keyin so'ng shundan oldin ortidan yakunida natijasida".split()
BIND_RIGHT = "va yoki lekin ammo biroq chunki garchi agar toki bass unda shuning ya".split()
LIGHT_VERBS = "ber qil ol bo' bo'lm qol chiq kir ket kel yot tur ot boshla davom yoz ura qayt qo' ko'ra".split()
MODALS = "mumkin kerak shart lozim zarur majbur imkoniyat edi emas edik edi-xolos bo'ladi bo'lish bo'lishi bo'lmaydi bo'ldi".split()
CONVERBS = "ib ilib yib ub quv lab lay lib masdan maslik may gani gan adigan moqchi ishi ish ra ta ay".split()
NUMERALS = """bir ikki uch tort besh olti yetti sakkiz toqqiz on yigirma qirq ellik oltmish yetmish sakson toqson yuz ming
    million milliard yarim necha""".split()
UNITS = """kishi odam inson nafar yil oy kun soat minut sekund metr kilogramm tonna dona marta martaba foiz million milliard
    yuz ming""".split()
PAIRS = (("shuning", "uchun"), ("shu", "sababli"), ("garchi", "bo'lsa"), ("qarab", "turib"), ("nisbatan", "olganda"), ("bir", "necha"))
CLAUSE_END = ".?!:;,—…"
PENALTY = 260.0


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def folded(word: Column) -> Column:
    """Lower case, one apostrophe, no punctuation at the ends. Most words are plain letters, which one look tells."""
    low = F.lower(word)
    one = F.translate(low, APOSTROPHES, "'" * len(APOSTROPHES))
    return F.when(low.rlike("^[a-z0-9_']*$"), low).otherwise(F.regexp_replace(one, r"(?U)^[^\w']+|[^\w']+$", ""))


def bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


LAWS = ("postposition", "compound_verb", "bind_right", "pair", "numeral_unit")


def _laws(left: Column, a: Column, b: Column) -> dict[str, Column]:
    """Whether each law is broken by a cut, from the word before it and both words folded."""
    starts = lambda stems: "^(" + "|".join(stems) + ")"
    pair = F.lit(False)
    for x, y in PAIRS:
        pair |= (a == x) & (b == y)
    return dict(
        postposition=b.isin(POSTPOSITIONS) | (b.isin(AMBIGUOUS) & ~F.rtrim(left).rlike(f"[{CLAUSE_END}]$")),
        compound_verb=(b != "") & (b.isin(MODALS) | b.rlike(starts(LIGHT_VERBS))) & a.rlike("(" + "|".join(CONVERBS) + ")$"),
        bind_right=a.isin(BIND_RIGHT),
        pair=pair,
        numeral_unit=(a.rlike(r"^\d+$") | a.isin(NUMERALS)) & b.rlike(starts(UNITS)),
    )


def _codes(left: Column, a: Column, b: Column) -> Column:
    """Codes of the laws that a cut breaks."""
    found = [F.when(when, F.lit(code)) for code, when in _laws(left, a, b).items()]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def junction_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, k, left, right and a boolean for each law: one row per junction, all in generated code.

    Rows of a text stay in its task, so what is summed per text is summed before any shuffle.
    """
    words = texts.select(key, words_of(F.col(text)).alias("w")).filter(F.size("w") > 1)
    words = words.select(key, "w", F.transform("w", folded).alias("f"))  # each word once, though it stands at two junctions
    tail = lambda c: F.slice(c, 2, F.size(c))
    pairs = F.arrays_zip(F.col("w").alias("left"), tail("w").alias("right"), F.col("f").alias("_a"), tail("f").alias("_b"))
    rows = words.select(key, F.posexplode(pairs).alias("k", "j")).select(key, (F.col("k") + 1).alias("k"), "j.*").filter("right IS NOT NULL")
    return rows.withColumns(_laws(F.col("left"), F.col("_a"), F.col("_b"))).drop("_a", "_b")


def fault_sum() -> Column:
    """How many laws a row of ``junction_rows`` breaks."""
    return sum((F.col(c).cast("int") for c in LAWS[1:]), F.col(LAWS[0]).cast("int"))


def faults(left: Column, right: Column) -> Column:
    """Codes of the laws that a cut between two words breaks."""
    words = F.struct(left.alias("l"), folded(left).alias("a"), folded(right).alias("b"))
    return bound(words, lambda w: _codes(w.l, w.a, w.b))


def judged(words: Column) -> Column:
    """array<struct<k, left, right, codes>> of a text's junctions; none for fewer than two words. Each word is folded once."""
    n = lambda t: F.when(F.size(t.w) > 1, F.sequence(F.lit(1), F.size(t.w) - 1)).otherwise(F.array().cast("array<int>"))

    def one(t: Column, k: Column) -> Column:
        left = F.get(t.w, k - 1)
        return F.struct(k.alias("k"), left.alias("left"), F.get(t.w, k).alias("right"), _codes(left, F.get(t.f, k - 1), F.get(t.f, k)).alias("codes"))

    with_folds = bound(words, lambda w: F.struct(w.alias("w"), F.transform(w, folded).alias("f")))
    return bound(with_folds, lambda t: F.transform(n(t), lambda k: one(t, k)))
