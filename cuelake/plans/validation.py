"""Checks of requests, and small views of users, jobs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuelake.functions import validation as C
from cuelake.plans.registry import query


@query("texts_checked", "SELECT doc_id, CASE WHEN text IS NULL THEN 'not_text' WHEN regexp_full_match(text, '\\s*') THEN 'blank' WHEN length(text) > 5000 THEN 'too_long' END AS code FROM documents")
def _(v):
    return v.documents.select("doc_id", C.text_code(F.col("text")).alias("code"))


@query(
    "terms_checked",
    """
WITH k AS (SELECT p_size AS user_id, p_name AS raw, substr(trim(p_name), 1, 120) AS s, substr(trim(CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE p_brand END), 1, 120) AS t FROM part),
c AS (SELECT user_id, count(DISTINCT raw) AS sent, count(DISTINCT s) FILTER (WHERE s <> '' AND t <> '') AS kept FROM k GROUP BY user_id)
SELECT user_id, CASE WHEN sent <= 100 THEN kept END AS terms, CASE WHEN sent > 100 THEN 'too_many_terms' END AS code FROM c""",
)
def _(v):
    terms = v.part.select(F.col("p_size").alias("user_id"), F.col("p_name").alias("src"), F.when(F.col("p_partkey") % 9 == 0, "  ").otherwise(F.col("p_brand")).alias("tgt"))
    return C.terms_checked(terms, "user_id", "src", "tgt")


_TIMES = """CASE event_id % 13 WHEN 0 THEN -1.0 WHEN 1 THEN 90000.0 ELSE event_id % 500 END AS start,
  CASE event_id % 11 WHEN 0 THEN 0.5 WHEN 1 THEN 90000.0 ELSE event_id % 500 + 2 END AS e, CASE event_id % 17 WHEN 0 THEN '  ' WHEN 1 THEN repeat(event_type, 90) ELSE event_type END AS t"""


@query(
    "cues_checked",
    f"""
WITH r AS (SELECT user_id, event_id, {_TIMES} FROM events), m AS (SELECT user_id, count(*) > 400 AS many FROM events GROUP BY user_id)
SELECT r.user_id, event_id, CASE WHEN m.many THEN 'too_many_lines' WHEN trim(t) = '' THEN 'text_required' WHEN NOT (start BETWEEN -0.001 AND 86400 AND e BETWEEN start - 0.001 AND 86400) THEN 'impossible_timings'
  WHEN length(t) > 300 THEN 'text_too_long' END AS code, length(substr(t, 1, 300)) AS kept FROM r JOIN m ON m.user_id = r.user_id""",
)
def _(v):
    rows = v.events.selectExpr("user_id", "event_id", *_sql_columns(_TIMES))
    cues = rows.select("user_id", F.col("event_id").alias("idx"), F.col("start").cast("double").alias("start"), F.col("e").cast("double").alias("end"), F.col("t").alias("text"))
    return C.cues_checked(cues, "user_id").select("user_id", F.col("idx").alias("event_id"), "code", F.length("text").cast("long").alias("kept"))


def _sql_columns(text: str) -> list[str]:
    """The columns of a select list whose expressions end in AS name."""
    parts = text.replace("\n", " ").split(" AS ")
    names = [p.split(",", 1)[0].strip() for p in parts[1:]]
    bodies = [parts[0], *(p.split(",", 1)[1] for p in parts[1:-1])]
    return [f"{b.strip()} AS {n}" for b, n in zip(bodies, names, strict=True)]


@query(
    "requests_checked",
    """
WITH c AS (SELECT conv_id, count(*) AS n, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: regexp_matches(t, '[\\pL\\pN]')))) AS words FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n = 0 THEN 'no_cues' WHEN n > 2000 THEN 'too_many_cues' WHEN NOT coalesce(shift BETWEEN 0.05 AND 2.0, false) THEN 'bad_shift' END AS align_code,
  CASE WHEN n = 0 THEN 'no_cues' WHEN n > 2000 THEN 'too_many_cues' WHEN words > 8000 THEN 'too_many_words' WHEN NOT coalesce(rate BETWEEN 6000 AND 192000, false) THEN 'bad_rate' WHEN coalesce(samples < 800, false) THEN 'too_short' END AS words_code
FROM (SELECT *, CASE conv_id % 5 WHEN 0 THEN 3.0 WHEN 1 THEN NULL ELSE 0.6 END AS shift, CASE conv_id % 7 WHEN 0 THEN 4000 WHEN 1 THEN NULL ELSE 8000 END AS rate, CASE conv_id % 3 WHEN 0 THEN 500 WHEN 1 THEN NULL ELSE 9000 END AS samples FROM c)""",
)
def _(v):
    words = F.size(F.filter(F.split("text", r"\s+"), lambda t: t.rlike(r"[\p{L}\p{N}]")))
    rows = v.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(words).alias("words"))
    k = F.col("conv_id")
    shift = F.when(k % 5 == 0, 3.0).when(k % 5 == 1, F.lit(None).cast("double")).otherwise(0.6)
    rate = F.when(k % 7 == 0, 4000).when(k % 7 == 1, F.lit(None).cast("int")).otherwise(8000)
    samples = F.when(k % 3 == 0, 500).when(k % 3 == 1, F.lit(None).cast("int")).otherwise(9000)
    return rows.select("conv_id", C.align_code(F.col("n"), shift).alias("align_code"), C.words_code(F.col("n"), F.col("words"), rate, samples).alias("words_code"))


@query(
    "request_shapes",
    "SELECT doc_id, CASE WHEN (said AND doc_id % 3 = 0) = (said AND doc_id % 2 = 0) THEN 'one_of_two' END AS code FROM (SELECT doc_id, regexp_matches(coalesce(text, ''), '\\S') AS said FROM documents)",
)
def _(v):
    return v.documents.select("doc_id", C.one_shape(F.when(F.col("doc_id") % 3 == 0, F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(" ")).alias("code"))


@query("engine_open", "SELECT event_id, coalesce(CASE event_type WHEN 'error' THEN false WHEN 'click' THEN true END, true) AS open FROM events")
def _(v):
    return v.events.select("event_id", C.engine_open(F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "click", True)).alias("open"))


@query("segments_capped", "SELECT job_id, id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS r FROM job_events) WHERE r <= 1500")
def _(v):
    return C.capped(v.job_events, "job_id", "id").select("job_id", "id")


@query("users_public", "SELECT id, name, contact, plan FROM users")
def _(v):
    return v.users.select("id", "name", "contact", "plan")


@query("user_by_id", "SELECT id, name, contact, plan FROM users WHERE id = 42")
def _(v):
    return v.users.filter("id = 42").select("id", "name", "contact", "plan")


@query("job_engines", "SELECT id, CASE id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'demo' ELSE 'real' END AS asr, id % 3 = 1 AS demo, CASE id % 3 WHEN 1 THEN 'no binary' ELSE '' END AS reason FROM jobs")
def _(v):
    meta = F.when(F.col("id") % 3 == 0, "{}").when(F.col("id") % 3 == 1, '{"asr_mode":"demo","asr_demo":true,"asr_reason":"no binary"}').otherwise('{"asr_mode":"real","asr_demo":false}')
    return v.jobs.select("id", C.engines(meta).alias("e")).select("id", "e.*")


@query(
    "media_of_pages",
    "SELECT page_id, CASE WHEN size > 0 THEN CASE page_id % 5 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' END END AS kind, CASE WHEN size > 0 THEN CASE page_id % 5 WHEN 0 THEN 'audio/wav' WHEN 1 THEN 'video/quicktime' END END AS mime, CASE WHEN page_id % 5 < 2 AND size > 0 THEN size END AS bytes FROM (SELECT page_id, coalesce(strlen(html), 0) AS size FROM pages)",
)
def _(v):
    name = F.concat(F.lit("/data.d/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 0, ".WAV").when(F.col("page_id") % 5 == 1, ".mov").when(F.col("page_id") % 5 == 2, ".exe").otherwise(""))
    m = v.pages.select("page_id", C.media(name, F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("m"))
    return m.select("page_id", "m.kind", "m.mime", "m.bytes")


@query("file_labels", "SELECT DISTINCT kind, upper(kind) AS label FROM artifacts")
def _(v):
    return v.artifacts.select("kind").distinct().select("kind", C.label_of(F.col("kind")).alias("label"))


@query("stamps", "SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM jobs")
def _(v):
    return v.jobs.select("id", C.iso_stamp(F.col("created_at").cast("timestamp")).alias("stamp"))


@query("rows_recent", "SELECT id, step, substr(coalesce(message, ''), 1, 3) AS message FROM job_events ORDER BY id DESC LIMIT 10")
def _(v):
    rows = v.job_events.orderBy(F.desc("id")).limit(10)
    return rows.select("id", "step", F.substring(F.coalesce("message", F.lit("")), 1, 3).alias("message"))


@query("reports_cut", "SELECT job_id, least(count(*), 200) AS shown, count(*) > 200 AS cut FROM job_events GROUP BY job_id")
def _(v):
    # the first of a report by id; how many there are is a count, so no list grows beyond what is shown
    per = v.job_events.groupBy("job_id").agg(F.count("*").alias("n"))
    first = C.capped(v.job_events, "job_id", "id", 201).groupBy("job_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rows = per.join(first, "job_id").select("job_id", C.cut_list(F.col("ids"), 200).alias("c"))
    return rows.select("job_id", F.size("c.items").cast("long").alias("shown"), "c.cut")


@query("evidence_words", "SELECT conv_id, turn, array_to_string(list_sort(list_filter(['and', 'not', 'the', 'you'], lambda w: list_contains(regexp_extract_all(lower(coalesce(text, '')), '[\\pL'']+'), w))), ',') AS words FROM conversations")
def _(v):
    return v.conversations.select("conv_id", "turn", F.array_join(C.shared_words(F.col("text"), ["and", "not", "the", "you"]), ",").alias("words"))
