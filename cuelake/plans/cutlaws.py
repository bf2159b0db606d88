"""Queries over the cut laws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuelake.operators import cutlaws as C
from cuelake.plans.registry import query

_Q = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_ALT = lambda xs: "|".join(xs).replace("'", "''")
_FOLD = lambda x: f"regexp_replace(regexp_replace(translate(lower({x}), 'ʻ‘’ʼ`', ''''''''''''), '^[^\\p{{L}}\\p{{N}}_'']+', ''), '[^\\p{{L}}\\p{{N}}_'']+$', '')".replace("{{", "{").replace("}}", "}")


def _laws(words: str) -> str:
    pairs = " OR ".join(f"(a = '{x}' AND b = '{y}')" for x, y in ((p.replace("'", "''"), q.replace("'", "''")) for p, q in C.PAIRS))
    return f"""
WITH w AS ({words}),
j AS (SELECT id, k, ws[k] AS l, ws[k + 1] AS r FROM (SELECT id, ws, unnest(range(1, len(ws))) AS k FROM w)),
x AS (SELECT id, k, l, {_FOLD('l')} AS a, {_FOLD('r')} AS b FROM j),
f AS (SELECT id, k,
  (b IN ({_Q(C.POSTPOSITIONS)}) OR (b IN ({_Q(C.AMBIGUOUS)}) AND NOT regexp_matches(l, '[{C.CLAUSE_END}]$'))) AS postposition,
  (b <> '' AND regexp_matches(a, '({_ALT(C.CONVERBS)})$') AND (b IN ({_Q(C.MODALS)}) OR regexp_matches(b, '^({_ALT(C.LIGHT_VERBS)})'))) AS compound_verb,
  (a IN ({_Q(C.BIND_RIGHT)})) AS bind_right, ({pairs}) AS pair,
  ((regexp_matches(a, '^[0-9]+$') OR a IN ({_Q(C.NUMERALS)})) AND regexp_matches(b, '^({_ALT(C.UNITS)})')) AS numeral_unit FROM x)
"""


_DOCS = _laws("SELECT doc_id AS id, regexp_extract_all(text, '\\S+') AS ws FROM documents")
_HITS = " + ".join(f"CAST({c} AS INTEGER)" for c in ("postposition", "compound_verb", "bind_right", "pair", "numeral_unit"))


@query("cut_ruler", _DOCS + f"SELECT id AS doc_id, count(*) AS positions, count(*) FILTER (WHERE {_HITS} = 0) AS legal, CAST(sum({_HITS}) AS BIGINT) AS fault_count FROM f GROUP BY id")
def _(v):
    rows = C.junction_rows(v.documents, "doc_id", "text").select("doc_id", C.fault_sum().alias("n"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("positions"), F.count_if(F.col("n") == 0).alias("legal"), F.sum("n").alias("fault_count"))


@query(
    "cut_faults_by_code",
    _DOCS
    + "SELECT code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN postposition THEN 'postposition' END, CASE WHEN compound_verb THEN 'compound_verb' END, CASE WHEN bind_right THEN 'bind_right' END, CASE WHEN pair THEN 'pair' END, CASE WHEN numeral_unit THEN 'numeral_unit' END], lambda c: c IS NOT NULL)) AS code FROM f) GROUP BY code",
)
def _(v):
    rows = C.junction_rows(v.documents, "doc_id", "text").agg(*[F.count_if(F.col(c)).alias(c) for c in C.LAWS])
    return rows.unpivot([], list(C.LAWS), "code", "n").filter("n > 0")


@query("cut_illegal_positions", _DOCS + f"SELECT id AS doc_id, k, {_HITS} AS faults, ({_HITS}) * 260.0::DOUBLE AS penalty FROM f WHERE {_HITS} > 0")
def _(v):
    rows = C.junction_rows(v.documents, "doc_id", "text").withColumn("faults", C.fault_sum()).filter("faults > 0")
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), "faults", (F.col("faults") * C.PENALTY).alias("penalty"))


_BOUNDS = _laws("SELECT doc * 100000 + idx AS id, [list_extract(regexp_extract_all(text, '\\S+'), -1), list_extract(regexp_extract_all(nxt, '\\S+'), 1)] AS ws FROM (SELECT *, lead(text) OVER (PARTITION BY doc ORDER BY idx) AS nxt FROM cues) WHERE regexp_matches(text, '\\S') AND regexp_matches(nxt, '\\S')")


@query("cut_boundaries", _BOUNDS + f"SELECT id // 100000 AS doc, count(*) AS measured, count(*) FILTER (WHERE {_HITS} > 0) AS hard FROM f GROUP BY 1")
def _(v):
    return _bounds(v.cues)


def _bounds(cues):
    nxt = F.lead("text").over(Window.partitionBy("doc").orderBy("idx"))
    rows = cues.withColumn("nxt", nxt).select("doc", C.words_of(F.col("text")).alias("a"), C.words_of(F.col("nxt")).alias("b")).filter((F.size("a") > 0) & (F.size("b") > 0))
    hard = F.size(C.faults(F.get("a", F.size("a") - 1), F.get("b", F.lit(0)))) > 0
    return rows.groupBy("doc").agg(F.count("*").alias("measured"), F.count_if(hard).alias("hard"))


#: Cues that begin with a postposition, or end with a word that binds to the right, one in three.
_PUT = "CASE idx % 3 WHEN 1 THEN 'uchun ' || text ELSE CASE WHEN doc % 2 = 0 THEN text || ' va' ELSE text END END"


@query("cut_boundaries_planted", _BOUNDS.replace("FROM cues)", f"FROM (SELECT doc, idx, {_PUT} AS text FROM cues))") + f"SELECT id // 100000 AS doc, count(*) AS measured, count(*) FILTER (WHERE {_HITS} > 0) AS hard FROM f GROUP BY 1")
def _(v):
    return _bounds(v.cues.selectExpr("doc", "idx", f"{_PUT} AS text"))


#: The driver's texts break no law, so the same queries run on texts with words of the laws put in.
_PLANTED = _DOCS.replace("FROM documents", "FROM planted")


@query("cut_ruler_planted", _PLANTED + f"SELECT id AS doc_id, count(*) AS positions, count(*) FILTER (WHERE {_HITS} = 0) AS legal, CAST(sum({_HITS}) AS BIGINT) AS fault_count FROM f GROUP BY id")
def _(v):
    rows = C.junction_rows(v.planted, "doc_id", "text").select("doc_id", C.fault_sum().alias("n"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("positions"), F.count_if(F.col("n") == 0).alias("legal"), F.sum("n").alias("fault_count"))


@query("cut_faults_planted", _PLANTED + "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {c}" for c in C.LAWS) + " FROM f")
def _(v):
    return C.junction_rows(v.planted, "doc_id", "text").agg(*[F.count_if(F.col(c)).alias(c) for c in C.LAWS])


@query("cut_positions_planted", _PLANTED + f"SELECT id AS doc_id, k, {_HITS} AS faults, ({_HITS}) * 260.0::DOUBLE AS penalty FROM f WHERE {_HITS} > 0")
def _(v):
    rows = C.junction_rows(v.planted, "doc_id", "text").withColumn("faults", C.fault_sum()).filter("faults > 0")
    return rows.select("doc_id", F.col("k").cast("long").alias("k"), "faults", (F.col("faults") * C.PENALTY).alias("penalty"))
