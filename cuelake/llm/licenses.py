"""Licence scans by canonical digest lookup (native).

A text is brought to lower case, loses copyright notices (from a mark at the beginning of a line, also after comment marks, that a
sign or a year follows, to the line's end) and "all rights reserved", has every run
of anything but letters and digits turned into one space and equivalent spellings made one; the digest of what is left
is looked up among digests of known texts, made by the same expression. Whole texts are compared, never parts.

Plan: one scan without a shuffle while the known texts number at most ``BROADCAST_KNOWN``; a larger table joins by shuffle on
the digest, where adaptive execution splits a hot one.

Defined results: null text has no digest and no licence; a text with nothing left has the digest of nothing and no licence;
rows that share a doc_id each get a row; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare, table
from .license_texts import DIGESTS, KNOWN, SPELLINGS

BROADCAST_KNOWN = 20_000
#: A notice from the beginning of its line: "copyright" with a sign or a year, or a sign with a year; "all rights reserved" wherever it stands.
#: The marks before it are one class and no repeated group, which would take stack for each mark of a long line.
NOTICE = r"(^|\n)[ \t/*#;%!>-]*(copyright[ \t:]*(\(c\)|©|[0-9]{4})|(\(c\)|©)[ \t]*(copyright|[0-9]{4}))[^\n]*"
RESERVED = r"all rights reserved"
NOT_WORDS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """What is left of a text: words in lower case, one space before and after each."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), NOTICE, "\n"), RESERVED, " ")
    words = F.regexp_replace(F.concat(F.lit(" "), kept, F.lit(" ")), NOT_WORDS, " ")
    for other, one in SPELLINGS:
        words = F.replace(words, F.lit(other), F.lit(one))
    return words


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """digest, license_id: one row for each digest, from (license_id, text) and from (license_id, digest)."""
    rows = spark.createDataFrame(list(known), "license_id string, text string").select("license_id", digest(F.col("text")).alias("digest"))
    ready = spark.createDataFrame(list(digests), "license_id string, digest string")
    return rows.unionByName(ready).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs with digest and license_id, which replace columns of those names; known: digest, license_id."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("digest", "license_id")])
    (other,) = spare(docs.columns, "digest")
    named = known.select(F.col("digest").alias(other), "license_id")
    if named.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN:
        named = F.broadcast(named)
    return docs.withColumn("digest", digest(F.col("text"))).join(named, F.col("digest") == F.col(other), "left").drop(other)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs, known_digests(spark)).select("doc_id", "digest", "license_id")


def _sql_canonical(text: str) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    kept = f"regexp_replace(regexp_replace(lower({text}), {q(NOTICE)}, chr(10), 'g'), {q(RESERVED)}, ' ', 'g')"
    words = f"regexp_replace(' ' || {kept} || ' ', {q(NOT_WORDS)}, ' ', 'g')"
    for other, one in SPELLINGS:
        words = f"replace({words}, {q(other)}, {q(one)})"
    return words


def _sql() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({q(k)}, {q(t)})" for k, t in KNOWN)
    ready = ", ".join(f"({q(k)}, {q(d)})" for k, d in DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256({_sql_canonical("text")}) AS digest FROM (VALUES {values}) AS k(license_id, text)
    UNION ALL SELECT license_id, digest FROM (VALUES {ready}) AS r(license_id, digest)) GROUP BY 1
), d AS (SELECT doc_id, sha256({_sql_canonical("text")}) AS digest FROM documents)
SELECT d.doc_id, d.digest, known.license_id FROM d LEFT JOIN known ON d.digest = known.digest
"""


OP3_SQL = _sql()
