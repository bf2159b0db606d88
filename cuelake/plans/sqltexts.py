"""Queries written as SQL texts over the table functions."""

from __future__ import annotations

from cuelake.functions import tables
from cuelake.plans.cutlaws import _HITS, _PLANTED
from cuelake.plans.registry import query
from cuelake.sources import sinks


def _sql(v, text: str, **frames):
    tables.register(v.spark)
    return v.spark.sql(text, **frames)


@query(
    "sql_tokens",
    "SELECT doc_id, count(*) AS tokens, CAST(max(length(w)) AS INTEGER) AS longest FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\\S+')) AS w FROM documents) GROUP BY doc_id",
)
def _(v):
    text = "SELECT d.doc_id, count(*) AS tokens, max(length(t.token)) AS longest FROM {documents} AS d, LATERAL tokens(d.text) AS t GROUP BY d.doc_id"
    return _sql(v, text, documents=v.documents)


@query(
    "sql_parsed_srt",
    "SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS INTEGER) AS pos, start_s AS \"start\", end_s AS \"end\", length(regexp_replace(text, '\\s', '', 'g')) AS chars FROM cues WHERE regexp_matches(text, '\\S')",
)
def _(v):
    text = "SELECT s.doc, p.pos, p.start, p.end, CAST(length(regexp_replace(p.text, '\\\\s', '')) AS BIGINT) AS chars FROM {files} AS s, LATERAL parse_srt(s.body) AS p"
    return _sql(v, text, files=sinks.to_srt(v.cues, "doc", "idx", "start_s", "end_s", "text"))


@query("sql_illegal_cuts", _PLANTED + f"SELECT id AS doc_id, CAST(k AS INTEGER) AS k, {_HITS} AS faults FROM f WHERE {_HITS} > 0")
def _(v):
    return _sql(v, "SELECT p.doc_id, c.k, c.faults FROM {planted} AS p, LATERAL illegal_cuts(p.text) AS c", planted=v.planted)
