"""Script conversion between Cyrillic, legacy Latin and reformed Latin.

Counting, detection and normalising are column expressions, and so is conversion between the Latin alphabets wherever a text has none of the
reformed letters: there only pairs of letters change. Conversion that depends on the case of the whole word around a letter, which
column functions cannot say, runs on Arrow batches, on those texts alone that need it, and only words with such a letter are looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the Cyrillic alphabet and what they become.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "j", "з": "z", "и": "i", "й": "y",
    "к": "k", "қ": "q", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ў": "o'", "ф": "f", "х": "x", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "э": "e", "ю": "yu",
    "я": "ya", "ғ": "g'", "ҳ": "h", "ң": "ng", "ә": "a", "ө": "o", "ү": "u", "ӣ": "i", "ӯ": "u",
}
#: Latin letters and pairs and what they become.
LATIN = {
    "g'": "ғ", "o'": "ў", "ch": "ч", "shch": "щ", "sh": "ш", "yo": "ё", "yu": "ю", "ya": "я", "ts": "ц", "q": "қ",
    "h": "ҳ", "a": "а", "b": "б", "v": "в", "g": "г", "d": "д", "e": "е", "j": "ж", "z": "з", "i": "и", "y": "й",
    "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "r": "р", "s": "с", "t": "т", "u": "у", "f": "ф", "x": "х",
}
#: The reformed letters, the apostrophes that count as one, the official one, names of targets.
REFORMED = {"o'": "ö", "g'": "ğ", "sh": "ş", "ch": "ç"}
APOSTROPHES = "ʻ’`´ʼ"
OFFICIAL = "ʻ"
TARGETS = {"latin": "latin", "lat": "latin", "cyrillic": "cyrillic", "cyr": "cyrillic", "new_latin": "new_latin", "newlatin": "new_latin", "new": "new_latin"}

_RUN = re.compile(r"[^\W\d_]+")
_NEW_LETTERS = "öğşçÖĞŞÇ"
_TWO = "".join(v.upper() for k, v in REFORMED.items() if k.isalpha())
_ANY_NEW = re.compile(f"[{_NEW_LETTERS}]")
_ANY_CYRILLIC_LETTER = re.compile("[" + "".join(sorted({*CYRILLIC, *(k.upper() for k in CYRILLIC)})) + "]")
_TITLE = lambda s: s[:1].upper() + s[1:]


def _tables(letters: dict[str, str]) -> tuple[dict[int, str], dict[int, str]]:
    """Translation tables for words in capitals and for all others."""
    low = {ord(k): v for k, v in letters.items()}
    return low | {ord(k.upper()): v.upper() for k, v in letters.items()}, low | {ord(k.upper()): _TITLE(v) for k, v in letters.items()}


_CYR = _tables(CYRILLIC)
_OLD = _tables({v: k for k, v in REFORMED.items()})
#: Capitals that the two tables of an alphabet replace otherwise; where a text has none, its words needn't be looked at.
_BY_CASE = {id(t): re.compile("[" + "".join(chr(c) for c in t[0] if t[0][c] != t[1][c]) + "]") for t in (_CYR, _OLD)}


def _by_run(text: str, tables: tuple[dict[int, str], dict[int, str]]) -> str:
    """Letters replaced; a word wholly in capitals keeps them in every letter of the replacement."""
    if not _BY_CASE[id(tables)].search(text):
        return text.translate(tables[1])
    return _RUN.sub(lambda m: m[0].translate(tables[0] if m[0].isupper() else tables[1]), text)


def _pattern(keys) -> re.Pattern:
    both = lambda c: f"[{c}{c.upper()}]" if c.upper() != c else re.escape(c)
    return re.compile("|".join("".join(map(both, k)) for k in sorted(keys, key=len, reverse=True)))


_REFORM_PAIRS = _pattern(REFORMED)
#: Pairs in an order in which replacing one after another gives what reading from left to right gives: ts before what begins with s, yo before o'.
_IN_ORDER = ("ts", "yo", "shch", "sh", "ch", "g'", "o'", "ya", "yu")
#: Every way to write a pair, with its letter, a capital where the pair begins with one; single letters.
_PAIRS_IN_ORDER = [
    ("".join(w), LATIN[p].upper() if w[0].isupper() else LATIN[p]) for p in _IN_ORDER for w in product(*[(c, c.upper()) if c.isalpha() else (c,) for c in p])
]
_SINGLES = {ord(x): y for k, c in LATIN.items() if len(k) == 1 for x, y in ((k, c), (k.upper(), c.upper()))}


def cyr2lat(text: str) -> str:
    return _by_run(text, _CYR) if _ANY_CYRILLIC_LETTER.search(text) else text


def lat2cyr(text: str) -> str:
    for written, letter in _PAIRS_IN_ORDER:
        text = text.replace(written, letter)
    return text.translate(_SINGLES)


def normalize(text: str) -> str:
    """One apostrophe, composed letters."""
    return unicodedata.normalize("NFC", text.translate({ord(a): "'" for a in APOSTROPHES}))


def from_reformed(text: str) -> str:
    return _by_run(text, _OLD) if _ANY_NEW.search(text) else text


def to_reformed(text: str) -> str:
    legacy = from_reformed(normalize(text))
    return _REFORM_PAIRS.sub(lambda m: REFORMED[m[0].lower()].upper() if m[0][:1].isupper() else REFORMED[m[0].lower()], legacy)


def to_official(text: str) -> str:
    return re.sub(r"([oOgG])'", rf"\1{OFFICIAL}", text)


_ANY_CYR = re.compile(r"[Ѐ-ӿ]")
_ANY_LAT = re.compile(r"[a-zA-ZöğşçÖĞŞÇ]")


def transliterate(text: str, to: str = "latin") -> str:
    """Text in the target script; what is in it already stays. Unknown targets mean latin."""
    target = TARGETS.get(to.strip().lower(), "latin")
    cyr = len(_ANY_CYR.findall(text))
    if target == "cyrillic":
        if cyr > len(_ANY_LAT.findall(text)):
            return unicodedata.normalize("NFC", text)
        return unicodedata.normalize("NFC", lat2cyr(from_reformed(normalize(text))))
    legacy = from_reformed(normalize(cyr2lat(text) if cyr else text))
    return unicodedata.normalize("NFC", to_reformed(legacy) if target == "new_latin" else legacy)


#: Texts that are Python objects at once.
AT_ONCE = 64


def in_python(convert) -> Callable[[Column], Column]:
    """A text function as a column function. A few texts are Python objects at a time, the others lie in Arrow buffers; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([None if t is None else convert(t) for t in texts.slice(at, AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(texts), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(run, "string")


#: Letters beyond ASCII that are composed as they stand, so that NFC leaves a text of them as it is: Latin-1, Cyrillic, punctuation of texts.
_COMPOSED = r"^[\x00-\x7F\u00A0-\u00FF\u0100-\u017F\u0400-\u045F\u0490-\u04FF\u02BB\u02BC\u2010-\u2027\u2030-\u205E\u20AC]*$"


def is_new_latin(text: Column) -> Column:
    """Whether a text has a letter of the reformed alphabet."""
    return text.rlike(f"[{_NEW_LETTERS}]")


def _one_apostrophe(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))


def _pairs_reformed(text: Column) -> Column:
    """o', g', sh, ch in any case to the reformed letters, capital where the pair begins with a capital."""
    for pair, letter in REFORMED.items():
        for first in (pair[0], pair[0].upper()):
            for second in {pair[1], pair[1].upper()}:
                text = F.replace(text, F.lit(first + second), F.lit(letter.upper() if first.isupper() else letter))
    return text


def _pairs_old(text: Column) -> Column:
    """The reformed letters as pairs; not for capital letters that become two, as those follow the case of their word."""
    for pair, letter in REFORMED.items():
        text = F.replace(text, F.lit(letter), F.lit(pair))
        if not pair[1].isalpha():
            text = F.replace(text, F.lit(letter.upper()), F.lit(_TITLE(pair)))
    return text


_SINGLE = {k: v for k, v in LATIN.items() if len(k) == 1}


def _cyrillic(text: Column) -> Column:
    """Latin letters of the old alphabet as Cyrillic ones, capital where a pair begins with a capital."""
    for written, letter in _PAIRS_IN_ORDER:
        text = F.replace(text, F.lit(written), F.lit(letter))
    low, to = "".join(_SINGLE), "".join(_SINGLE.values())
    return F.translate(text, low + low.upper(), to + to.upper())


def transliterated(text: Column, to: str = "latin") -> Column:
    """Null stays null. Texts without Cyrillic letters and without capitals that become two letters, already composed, stay in generated code."""
    target = TARGETS.get(to.strip().lower(), "latin")
    slow = in_python(lambda t: transliterate(t, to))
    plain = _pairs_old(_one_apostrophe(text))
    plain = _pairs_reformed(plain) if target == "new_latin" else _cyrillic(plain) if target == "cyrillic" else plain
    easy = text.rlike(_COMPOSED) & ~text.rlike(f"[Ѐ-ӿ{_TWO}]")
    # the function gets null for easy texts, so it works on the others alone
    return F.when(easy, plain).otherwise(slow(F.when(~easy, text)))


def normalized(text: Column) -> Column:
    """One apostrophe, composed letters."""
    easy = text.rlike(_COMPOSED)
    return F.when(easy, _one_apostrophe(text)).otherwise(in_python(normalize)(F.when(~easy, text)))


def romanized(text: Column) -> Column:
    """Cyrillic letters as Latin ones, one apostrophe, composed letters; Latin letters of any alphabet stay."""
    cyrillic = text.rlike("[Ѐ-ӿ]")
    return F.when(~cyrillic, normalized(text)).otherwise(in_python(lambda t: cyr2lat(normalize(t)))(F.when(cyrillic, text)))


def official(text: Column) -> Column:
    for c in "oOgG":
        text = F.replace(text, F.lit(f"{c}'"), F.lit(f"{c}{OFFICIAL}"))
    return text


def _letters_of(text: Column, kinds: str) -> Column:
    """How many letters of some kinds a text has: what is gone once their runs are taken out, so a match is a run and not a letter."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{kinds}]+", ""))


def cyrillic_count(text: Column) -> Column:
    return _letters_of(text, "Ѐ-ӿ")


def latin_count(text: Column) -> Column:
    return _letters_of(text, "a-zA-ZöğşçÖĞŞÇ")


def detected(text: Column) -> Column:
    """struct(script, cyrillic, latin, confidence): mixed if neither script has four fifths and both have a fifth; ties are latin."""

    def judged(x: Column) -> Column:
        c, n = x.c, x.n
        share = F.greatest(c, n) / (c + n)
        script = (
            F.when(c + n == 0, "other")
            .when((share < 0.8) & (F.least(c, n) / (c + n) >= 0.2), "mixed")
            .when(c > n, "cyrillic")
            .otherwise("latin")
        )
        confidence = F.when(c + n == 0, 0.0).otherwise(F.round(share, 3))
        return F.struct(script.alias("script"), c.alias("cyrillic"), n.alias("latin"), confidence.alias("confidence"))

    # the counts are made once, however often they are asked for
    counts = F.struct(cyrillic_count(text).alias("c"), latin_count(text).alias("n"))
    return F.get(F.transform(F.array(counts), judged), F.lit(0))


def word_count(text: Column) -> Column:
    """Tokens between white space that hold a letter."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t.rlike(r"\p{L}")))


def target_name(to: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    return names[F.lower(F.trim(to))]


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


#: Fragments of another language's function words, in either script.
MARKERS_CYRILLIC = ("и ", "в ", "не ", "что ", "но ", "или ", "как ", "это ")
MARKERS_LATIN = ("i ", "v ", "ne ", "no ", "ili ", "kak ", "eto ", "cto ")


def _count(text: Column, part: str) -> Column:
    """How often a part stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def code_switches(text: Column, latin: Column) -> Column:
    """How many markers of the other language a text has: Cyrillic ones in itself, Latin ones in its Latin form."""
    padded = lambda x: F.concat(F.lit(" "), F.lower(x), F.lit(" "))
    cyr, lat = padded(normalized(text)), padded(latin)
    return sum((_count(lat, m) for m in MARKERS_LATIN), sum((_count(cyr, m) for m in MARKERS_CYRILLIC), F.lit(0)))


def analyzed(texts: DataFrame, key: str, text: str, terms: list[str] | None = None) -> DataFrame:
    """key and the sixteen fields of a text's analysis. Each conversion is made once; null text counts as empty."""
    rows = texts.select(key, F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumns({"latin": transliterated(F.col("text"), "latin"), "cyrillic": transliterated(F.col("text"), "cyrillic")})
    rows = rows.withColumns({"new_latin": transliterated(F.col("latin"), "new_latin"), "d": detected(F.col("text"))})
    low = F.lower("text")
    found = F.filter(F.array(*[F.lit(t) for t in terms or []]).cast("array<string>"), lambda t: (t != "") & F.contains(low, F.lower(t)))
    return rows.select(
        key, "d.script", "d.confidence", F.col("d.cyrillic").alias("cyrillic_count"), F.col("d.latin").alias("latin_count"), word_count(F.col("text")).alias("words"),
        F.length("text").alias("chars"), "latin", "cyrillic", official(F.col("latin")).alias("official"), "new_latin", is_new_latin(F.col("text")).alias("has_reform_letters"),
        (F.col("d.cyrillic") > 0).alias("has_cyrillic_letters"), F.col("latin").rlike("[a-zA-Z]").alias("has_legacy_latin_letters"),
        code_switches(F.col("text"), F.col("latin")).alias("code_switch_hints"), found.alias("glossary_hits"), (F.col("d.cyrillic") > F.col("d.latin")).alias("is_cyrillic"),
    )


def converted(text: Column, to: str = "latin", with_official: bool = False, terms: dict[str, str] | None = None) -> Column:
    """Text in the target script, then with a glossary's terms, then, for the Latin target only, with official apostrophes."""
    from .glossary import applied

    out = transliterated(F.coalesce(text, F.lit("")), to)
    out = applied(out, terms) if terms else out
    return official(out) if with_official and TARGETS.get(to.strip().lower(), "latin") == "latin" else out


#: The small dictionary of the demo translation.
DICTIONARY = {
    "здравствуйте": "assalomu alaykum", "спасибо": "rahmat", "сегодня": "bugun", "завтра": "erta", "магазин": "do'kon", "цена": "narx",
    "скидка": "chegirma", "заказ": "buyurtma", "доставка": "yetkazib berish", "телефон": "telefon", "время": "vaqt", "деньги": "pul",
    "друг": "do'st", "дом": "uy", "вода": "suv", "хлеб": "non", "новый": "yangi", "хороший": "yaxshi", "большой": "katta",
    "клиент": "mijoz", "услуга": "xizmat", "оплата": "to'lov",
}


def looked_up(text: Column, src: str, tgt: str) -> Column:
    """Words of a text, parted by single spaces, replaced by a dictionary; signs around a word and a first capital stay. Null stays null."""
    table = DICTIONARY if (src, tgt) == ("ru", "uz") else {v: k for k, v in DICTIONARY.items()} if (src, tgt) == ("uz", "ru") else {}
    if src == "uz":
        text = normalized(transliterated(text, "latin")) if tgt != "uz" else normalized(text)
    if not table:
        return text
    words = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

    def one(word: Column) -> Column:
        core = F.regexp_replace(word, r"^[.,!?;:«»()]+|[.,!?;:«»()]+$", "")
        to = words[F.lower(core)]
        capital = core.rlike(r"^\p{Lu}")
        to = F.when(capital, F.concat(F.upper(F.substring(to, 1, 1)), F.substring(to, 2, 1000))).otherwise(to)
        return F.when(to.isNotNull(), F.replace(word, core, to)).otherwise(word)

    return F.array_join(F.transform(F.split(text, " "), one), " ")
