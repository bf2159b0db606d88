"""Script, word-count and glossary queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import glossary as G
from cuelake.functions import script as S
from cuelake.plans.registry import query

_C, _L = "len(regexp_extract_all(text, '[Ѐ-ӿ]'))", "len(regexp_extract_all(text, '[a-zA-ZöğşçÖĞŞÇ]'))"


@query(
    "script_detected",
    f"""
WITH n AS (SELECT doc_id, CAST({_C} AS BIGINT) AS cyrillic, CAST({_L} AS BIGINT) AS latin FROM documents)
SELECT doc_id, cyrillic, latin, CASE WHEN cyrillic + latin = 0 THEN 0 ELSE round(greatest(cyrillic, latin) / (cyrillic + latin), 3) END AS confidence,
  CASE WHEN cyrillic + latin = 0 THEN 'other' WHEN greatest(cyrillic, latin) / (cyrillic + latin) < 0.8 AND least(cyrillic, latin) / (cyrillic + latin) >= 0.2 THEN 'mixed' WHEN cyrillic > latin THEN 'cyrillic' ELSE 'latin' END AS script
FROM n""",
)
def _(v):
    return v.documents.select("doc_id", S.detected(F.col("text")).alias("d")).select("doc_id", "d.*")


@query("letter_words", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: regexp_matches(t, '\\p{L}'))) AS INTEGER) AS words FROM documents")
def _(v):
    return v.documents.select("doc_id", S.word_count(F.col("text")).alias("words"))


@query(
    "latin_normalized",
    "SELECT doc_id, nfc_normalize(translate(text, 'ʻ’`´ʼ', '''''''''''')) AS text FROM documents",
)
def _(v):
    return v.documents.select("doc_id", S.normalized(F.col("text")).alias("text"))


@query("official_apostrophes", "SELECT doc_id, replace(replace(replace(replace(text, 'o''', 'oʻ'), 'O''', 'Oʻ'), 'g''', 'gʻ'), 'G''', 'Gʻ') AS text FROM documents")
def _(v):
    return v.documents.select("doc_id", S.official(F.col("text")).alias("text"))


_Q = lambda x: "'" + x.replace("'", "''") + "'"


def _replaced(x: str, table: dict[str, str]) -> str:
    for old, new in table.items():
        x = f"replace({x}, {_Q(old)}, {_Q(new)})"
    return x


_PLAIN = f"nfc_normalize(translate(text, '{S.APOSTROPHES}', {chr(39) * (2 + 2 * len(S.APOSTROPHES))}))"
_OLD = {v: k for k, v in S.REFORMED.items()}
#: Runs of letters with reformed letters as pairs: all capitals in a run of capitals, else the first.
_UP = {k.upper(): v.upper() for k, v in _OLD.items()}
_TITLE = {k.upper(): v[0].upper() + v[1:] for k, v in _OLD.items()}
_RUNS = f"array_to_string(list_transform(regexp_extract_all({_PLAIN}, '\\pL+|[^\\pL]+'), lambda r: CASE WHEN upper(r) = r AND lower(r) <> r THEN {_replaced('r', _UP)} ELSE {_replaced('r', _OLD | _TITLE)} END), '')"
_REFORM = {a + b: v.upper() if a.isupper() else v for k, v in S.REFORMED.items() for a in (k[0], k[0].upper()) for b in sorted({k[1], k[1].upper()})}
#: Letters and pairs from left to right, the longest first; all become one letter, a capital if they begin with one.
_TOKENS = "(?is)" + "|".join(sorted(S.LATIN, key=len, reverse=True)) + "|."
_LETTERS = "MAP {" + ", ".join(f"{_Q(k)}: {_Q(c)}" for k, c in S.LATIN.items()) + "}"
_TO_CYRILLIC = f"""CASE WHEN len(regexp_extract_all(text, '[Ѐ-ӿ]')) > len(regexp_extract_all(text, '[a-zA-ZöğşçÖĞŞÇ]')) THEN nfc_normalize(text)
  ELSE array_to_string(list_transform(regexp_extract_all({_RUNS}, {_Q(_TOKENS)}), lambda t: CASE WHEN {_LETTERS}[lower(t)] IS NULL THEN t WHEN upper(t[1]) = t[1] THEN upper({_LETTERS}[lower(t)]) ELSE {_LETTERS}[lower(t)] END), '') END"""
_LATIN_UP, _LATIN_TITLE = {k.upper(): c.upper() for k, c in S.CYRILLIC.items()}, {k.upper(): c[:1].upper() + c[1:] for k, c in S.CYRILLIC.items()}
_BACK = f"nfc_normalize(array_to_string(list_transform(regexp_extract_all(text, '\\pL+|[^\\pL]+'), lambda r: CASE WHEN upper(r) = r AND lower(r) <> r THEN {_replaced('r', S.CYRILLIC | _LATIN_UP)} ELSE {_replaced('r', S.CYRILLIC | _LATIN_TITLE)} END), ''))"


@query("texts_to_cyrillic", f"SELECT doc_id, {_TO_CYRILLIC} AS text FROM documents")
def _(v):
    return v.documents.select("doc_id", S.transliterated(F.col("text"), "cyrillic").alias("text"))


@query("texts_round_trip", f"SELECT doc_id, {_BACK} AS text FROM (SELECT doc_id, {_TO_CYRILLIC} AS text FROM documents)")
def _(v):
    there = v.documents.select("doc_id", S.transliterated(F.col("text"), "cyrillic").alias("c"))
    return there.select("doc_id", S.transliterated(F.col("c"), "latin").alias("text"))


@query("texts_to_new_latin", f"SELECT doc_id, {_replaced(_RUNS, _REFORM)} AS text FROM documents")
def _(v):
    return v.documents.select("doc_id", S.transliterated(F.col("text"), "new_latin").alias("text"))


@query("html_escaped", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS text FROM documents")
def _(v):
    return v.documents.select("doc_id", S.html_escaped(F.col("text")).alias("text"))


#: Terms of the check; a job's own glossary takes their place.
TERMS = {"the": "der", "with": "mit", "All rights reserved": "Alle Rechte", "license": "Lizenz", "and": "und"}


@query(
    "glossary_hits",
    "SELECT doc_id, array_to_string(list_filter(['the', 'with', 'All rights reserved', 'license', 'and'], lambda t: contains(lower(text), lower(t))), ',') AS hits FROM documents",
)
def _(v):
    terms = F.array(*[F.lit(t) for t in TERMS])
    return v.documents.select("doc_id", F.array_join(G.hits(F.col("text"), terms), ",").alias("hits"))


def _with_terms(x: str) -> str:
    """Terms replaced in a text, whole words in any case: the phrase by what stands around it, then words among runs of letters and digits."""
    word, phrase = "[\\pL\\pN_]", next(k for k in TERMS if " " in k)
    x = f"regexp_replace({x}, '(?i)(^|[^\\pL\\pN_]){phrase}([^\\pL\\pN_]|$)', '\\1{TERMS[phrase]}\\2', 'g')"
    known = "MAP {" + ", ".join(f"'{k}': '{t}'" for k, t in TERMS.items() if k != phrase) + "}"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{word}+|[^\\pL\\pN_]+'), lambda t: coalesce({known}[lower(t)], t)), '')"


@query("glossary_applied", f"SELECT doc_id, {_with_terms('text')} AS text FROM documents")
def _(v):
    return v.documents.select("doc_id", G.applied(F.col("text"), TERMS).alias("text"))


@query("glossary_masked", "SELECT doc_id, true AS same FROM documents")
def _(v):
    m = v.documents.select("doc_id", "text", G.masked(F.col("text"), {k: k for k in TERMS}).alias("m"))
    restored = G.unmasked(F.col("m.text"), F.col("m.marks"))
    return m.select("doc_id", (F.lower(restored) == F.lower("text")).alias("same"))


@query("contacts_normalized", "SELECT id, CASE WHEN contact LIKE '%@%' THEN replace(lower(contact), ' ', '') WHEN regexp_matches(contact, '[0-9]') THEN '+' || regexp_replace(contact, '[^0-9]', '', 'g') ELSE lower(contact) END AS contact FROM users")
def _(v):
    c = F.col("contact")
    out = (
        F.when(F.contains(c, F.lit("@")), F.replace(F.lower(c), F.lit(" "), F.lit("")))
        .when(c.rlike("[0-9]"), F.concat(F.lit("+"), F.regexp_replace(c, "[^0-9]", "")))
        .otherwise(F.lower(c))
    )
    return v.users.select("id", out.alias("contact"))


@query("new_latin_flags", "SELECT doc_id, regexp_matches(text, '[öğşçÖĞŞÇ]') AS reformed FROM documents")
def _(v):
    return v.documents.select("doc_id", S.is_new_latin(F.col("text")).alias("reformed"))


#: A text in lower case with Latin letters of the old alphabet; letters with several forms have none in capitals there.
_LOW_LATIN = _replaced(f"lower({_PLAIN})", S.CYRILLIC | _OLD)
_MARKS = " + ".join(f"(length(b) - length(replace(b, '{m}', ''))) // {len(m)}" for m in S.MARKERS_LATIN)
_MARKS += " + " + " + ".join(f"(length(c) - length(replace(c, '{m}', ''))) // {len(m)}" for m in S.MARKERS_CYRILLIC)


@query("code_switches", f"SELECT doc_id, CAST({_MARKS} AS INTEGER) AS hints FROM (SELECT doc_id, ' ' || {_LOW_LATIN} || ' ' AS b, ' ' || lower({_PLAIN}) || ' ' AS c FROM documents)")
def _(v):
    return v.documents.select("doc_id", S.code_switches(F.col("text"), S.transliterated(F.col("text"), "latin")).alias("hints"))


def _official(x: str) -> str:
    return _replaced(x, {f"{c}'": f"{c}{S.OFFICIAL}" for c in "oOgG"})


@query(
    "text_analysis",
    f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, CAST({_C} AS BIGINT) AS c, CAST({_L} AS BIGINT) AS l, {_RUNS} AS latin, {_TO_CYRILLIC} AS cyrillic, ' ' || {_LOW_LATIN} || ' ' AS b, ' ' || lower({_PLAIN}) || ' ' AS low FROM t)
SELECT doc_id, CASE WHEN c + l = 0 THEN 'other' WHEN greatest(c, l) / (c + l) < 0.8 AND least(c, l) / (c + l) >= 0.2 THEN 'mixed' WHEN c > l THEN 'cyrillic' ELSE 'latin' END AS script,
  CASE WHEN c + l = 0 THEN 0 ELSE round(greatest(c, l) / (c + l), 3) END AS confidence, c AS cyrillic_count, l AS latin_count,
  CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '\\p{{L}}'))) AS INTEGER) AS words, length(text) AS chars, latin, cyrillic, {_official('latin')} AS official,
  {_replaced('latin', _REFORM)} AS new_latin, regexp_matches(text, '[öğşçÖĞŞÇ]') AS has_reform_letters, c > 0 AS has_cyrillic_letters, regexp_matches(latin, '[a-zA-Z]') AS has_legacy_latin_letters,
  CAST({_MARKS.replace('(c', '(low').replace('length(replace(c', 'length(replace(low')} AS INTEGER) AS code_switch_hints, list_filter(['the', 'with', 'All rights reserved', 'license', 'and'], lambda t: contains(lower(text), lower(t))) AS glossary_hits, c > l AS is_cyrillic FROM n""",
)
def _(v):
    return S.analyzed(v.documents, "doc_id", "text", list(TERMS))


_MARKS = " + ".join(f"(length(b) - length(replace(b, '{m}', ''))) // {len(m)}" for m in S.MARKERS_LATIN)


@query("texts_converted", f"SELECT doc_id, {_official(_with_terms('latin'))} AS text FROM (SELECT doc_id, {_RUNS} AS latin FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")
def _(v):
    return v.documents.select("doc_id", S.converted(F.col("text"), "latin", True, TERMS).alias("text"))


_WORDS = "MAP {" + ", ".join(f"'{v.replace(chr(39), chr(39) * 2)}': '{k}'" for k, v in S.DICTIONARY.items()) + "}"
_EDGE = "[.,!?;:«»()]+"


@query(
    "texts_looked_up",
    f"""
WITH w AS (SELECT doc_id, string_split({_RUNS}, ' ') AS ws FROM (SELECT doc_id, 'uy. ' || coalesce(text, '') || ' (Non)' AS text FROM documents)),
c AS (SELECT doc_id, list_transform(ws, lambda w: {{'w': w, 'core': regexp_replace(w, '^{_EDGE}|{_EDGE}$', '', 'g')}}) AS cs FROM w),
t AS (SELECT doc_id, list_transform(cs, lambda c: {{'w': c.w, 'core': c.core, 'into': {_WORDS}[lower(c.core)]}}) AS ts FROM c)
SELECT doc_id, array_to_string(list_transform(ts, lambda t: CASE WHEN t.into IS NULL THEN t.w WHEN regexp_matches(t.core, '^\\p{{Lu}}') THEN replace(t.w, t.core, upper(t.into[1]) || t.into[2:]) ELSE replace(t.w, t.core, t.into) END), ' ') AS text FROM t""",
)
def _(v):
    text = F.concat(F.lit("uy. "), F.coalesce("text", F.lit("")), F.lit(" (Non)"))
    return v.documents.select("doc_id", S.looked_up(text, "uz", "ru").alias("text"))
