"""The model's tables as views over the driver's tables.

A view is SQL that both Spark and the checking engine read alike; where the dialects part, it is a pair. Spark gets
DataFrames, lazily and each read with the columns it needs; the checking engine gets the same text as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The moment that stands for "now" in every report.
AS_OF = "2024-01-31 00:00:00"

VIEWS: dict[str, str | tuple[str, str]] = {
    "users": """
SELECT c_custkey AS id, c_name AS name, lower(c_name) AS contact,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'pro' WHEN 'BUILDING' THEN 'studio' ELSE 'free' END AS plan,
  DATE '2023-12-01' + CAST(c_custkey % 60 AS INT) AS created_on
FROM {customer}""",
    "ledger": """
SELECT event_id AS id, user_id, CAST(CASE WHEN event_type IN ('signup', 'purchase') THEN value ELSE -value END AS DECIMAL(18,4)) AS delta,
  CASE event_type WHEN 'purchase' THEN 'payment:click' WHEN 'signup' THEN 'bonus' WHEN 'error' THEN 'refund:job' ELSE 'job' END AS reason,
  'e' || CAST(event_id AS STRING) AS ref, ts AS created_at
FROM {events}""",
    "payments": """
SELECT event_id AS id, user_id, CASE WHEN event_id % 2 = 0 THEN 'payme' ELSE 'click' END AS provider, 'e' || CAST(event_id - event_id % 2 AS STRING) AS external_id,
  CASE event_id % 7 WHEN 0 THEN 12000000 WHEN 1 THEN 90000 WHEN 2 THEN 900 WHEN 3 THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS amount_minor,
  CASE event_id % 7 WHEN 0 THEN 'UZS' WHEN 1 THEN 'RUB' WHEN 2 THEN 'usd' WHEN 3 THEN 'USD' ELSE 'RUB' END AS currency, value / 10 AS minutes,
  CASE WHEN event_id % 5 = 0 THEN 'pending' ELSE 'paid' END AS status, ts AS created_at
FROM {events} WHERE event_type = 'purchase'""",
    "job_events": """
SELECT event_id AS id, user_id AS job_id, event_type AS step, 'm' || CAST(event_id AS STRING) AS message, props AS data, ts AS at FROM {events}""",
    "jobs": """
SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'dubbing' WHEN '2-HIGH' THEN 'subtitles' WHEN '3-MEDIUM' THEN 'transcribe' ELSE 'translate' END AS type,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'F' AND o_orderkey % 13 = 0 THEN 'canceled'
    WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'running' END AS status,
  o_totalprice / 1000 AS minutes, o_orderdate AS created_at, o_orderdate + INTERVAL 2 DAY AS updated_at,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{{"polish":true}}' ELSE '{{"diarize":true,"words":false}}' END AS meta_json
FROM {orders}""",
    "artifacts": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS job_id, CASE l_returnflag WHEN 'A' THEN 'srt' WHEN 'N' THEN 'ass' ELSE 'json' END AS kind,
  'p' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS path
FROM {lineitem}""",
    "notifications": """
SELECT event_id AS id, user_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN ts END AS read_at, ts AS created_at FROM {events}""",
    "shares": """
SELECT o_orderkey AS id, o_orderkey AS job_id, o_custkey AS user_id, o_orderdate AS created_at, o_orderdate + INTERVAL 72 HOUR AS expires_at FROM {orders}""",
    "sessions": """
SELECT 't' || CAST(c_custkey AS STRING) AS token, c_custkey AS user_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(1706659200 + (c_custkey % 100 - 50) * 3600 AS STRING) END AS expires_at,
  CAST(1706659200 - (c_custkey % 5) * 1800 AS STRING) AS last_seen_at
FROM {customer}""",
    "api_keys": """
SELECT s_suppkey AS id, s_nationkey AS user_id, s_name AS raw_key, CASE WHEN s_acctbal < 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS revoked_at FROM {supplier}""",
    "webhooks": """
SELECT s_suppkey AS id, s_nationkey AS user_id,
  CASE s_suppkey % 4 WHEN 0 THEN 'done, failed' WHEN 1 THEN 'done' WHEN 2 THEN ' failed ,,canceled' ELSE '' END AS events,
  CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS active
FROM {supplier}""",
    "glossary": """
SELECT p_partkey AS id, p_size AS user_id, split_part(p_name, ' ', 1) AS src_term, p_brand AS tgt_term FROM {part}""",
    "cues": """
SELECT doc, idx, text, role, CAST(upto - ms AS BIGINT) AS start_ms, CAST(upto AS BIGINT) AS end_ms,
  CAST(upto - ms AS BIGINT) / CAST(1000 AS DOUBLE) AS start_s, CAST(upto AS BIGINT) / CAST(1000 AS DOUBLE) AS end_s
FROM (
  SELECT conv_id AS doc, turn AS idx, text, role, ms, sum(ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM (SELECT *, greatest(2000, least(6000, CAST(floor(length(text) * 1000 / CAST(12 AS DOUBLE)) AS BIGINT))) AS ms FROM {conversations}) AS a
) AS b""",
    "planted": """
SELECT doc_id, replace(replace(replace(replace(replace(replace(text, ' the ', ' uch soat '), ' and ', ' va '), ' der ', ' u borib ketdi '), ' die ', ' shuning uchun '), ' que ', ' tekshirib, keyin '), ' de ', ' yozdi bilan ') AS text
FROM {documents}""",
    "levels": (
        """
SELECT vec_id AS tape, CAST(pos AS INT) AS f, abs(CAST(x AS DOUBLE)) AS level FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, x""",
        """
SELECT vec_id AS tape, CAST(i - 1 AS INTEGER) AS f, abs(CAST(embedding[i] AS DOUBLE)) AS level
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM {embeddings}) AS a""",
    ),
}

#: The cues with forms of address, answers, gaps and overlaps planted in them, so that every rule of speaker attribution has cases.
VIEWS["talk"] = f"""
SELECT doc, idx, (start_ms + shift) / CAST(1000 AS DOUBLE) AS start_s, (end_ms + shift) / CAST(1000 AS DOUBLE) AS end_s,
  CASE CAST((doc * 3 + idx) % 11 AS INT) WHEN 1 THEN 'Assalomu alaykum, ' || text WHEN 2 THEN 'Va alaykum assalom. ' || text WHEN 3 THEN text || ' Siz keldingizmi?' WHEN 4 THEN text || ' Men keldim.'
    WHEN 5 THEN 'ha' WHEN 6 THEN 'Rahmat, Ustoz aka. ' || text WHEN 7 THEN '— ' || text WHEN 8 THEN text || ' va' WHEN 9 THEN ' ' ELSE text END AS text
FROM (SELECT *, 2600 * CAST(floor(idx / CAST(3 AS DOUBLE)) AS BIGINT) - CASE WHEN idx % 5 = 4 THEN 300 ELSE 0 END AS shift FROM ({VIEWS["cues"]}) AS c) AS d"""

_NAME = re.compile(r"\{(\w+)\}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model view, or one of the driver's tables, as a DataFrame."""
    if name not in VIEWS:
        return read(spark, sf_dir, name)
    text = VIEWS[name]
    text = text if isinstance(text, str) else text[0]
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in set(_NAME.findall(text)) if t in TABLES})


def check_sql(query: str) -> str:
    """The query for the checking engine, with the views it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", query)]
    if not used:
        return query
    texts = {v: t if isinstance(t := VIEWS[v], str) else t[1] for v in used}
    ctes = ", ".join(f"{v} AS ({_NAME.sub(r'\1', texts[v]).replace('{{', '{').replace('}}', '}')})" for v in used)
    body = query.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[4:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


class Views:
    """Views as attributes: ``Views(spark, sf_dir).ledger``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)
