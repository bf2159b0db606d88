"""Checks, tags and small rules of requests and media, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes by extension, progress by step, what a profile covers, limits of listening.
SIGNATURES = {".wav": ("52494646",), ".mp3": ("494433", "FFFB", "FFF3", "FFF2"), ".ogg": ("4F676753",)}
BOXED = (".m4a", ".mp4", ".mov")
PROGRESS = {
    "queued": 5, "requeued": 5, "start": 12, "asr": 40, "align": 45, "diarize": 50, "translate": 65, "polish": 70, "words": 72, "tts": 85,
    "done": 100, "failed": 100, "canceled": 100, "orphan": 100,
}
SLACK_S, JOB_MOST_S = 60.0, 3600.0
PCM_RATE, PROFILE_WINDOW, PROFILE_WINDOWS = 8000, 8000, 4
LISTEN_S, LISTEN_SAMPLES = 900.0, 9_600_000


def finite(x: Column, default: float = 0.0) -> Column:
    """A text or number as a finite double, else the default."""
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(default)).otherwise(v)


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "on", "yes"), F.lit(False))


def cue_tag(text: Column) -> Column:
    """struct(speaker, text): a leading [Sn] taken off; null speaker without one."""
    tag = r"^\[S(\d+)\]\s*"
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.nullif(F.regexp_extract(text, tag, 1), F.lit("")).try_cast("int").alias("speaker"), F.regexp_replace(text, tag, "").alias("text"))


def media_fits(content: Column, ext: Column) -> Column:
    """Whether a file's first bytes fit its extension; unknown extensions and files under 12 bytes pass."""
    head = F.hex(F.substring(content, 1, 12))
    known = F.lit(False)
    for e, starts in SIGNATURES.items():
        known |= (ext == e) & head.rlike("^(" + "|".join(starts) + ")")
    known |= ext.isin(*BOXED) & (F.substring(head, 9, 8) == "66747970")
    return (F.octet_length(content) < 12) | ~ext.isin(*SIGNATURES, *BOXED) | known


def progress(step: Column) -> Column:
    steps = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])
    return F.coalesce(steps[step], F.lit(30))


def listening(minutes: Column) -> Column:
    """struct(want, paid): seconds to listen to and seconds paid for."""
    paid = F.greatest(minutes, F.lit(0.1)) * 60.0
    return F.struct(F.least(paid + SLACK_S, F.lit(JOB_MOST_S)).alias("want"), paid.alias("paid"))


def cut_short(heard: Column, want: Column, paid: Column) -> Column:
    return (heard >= want - 0.5) & (heard < paid - 0.5)


def listen_window(samples: Column, rate: Column) -> Column:
    """Null, or the code of the refusal."""
    return F.when(~rate.between(6000, 192000), "bad_rate").when((samples > LISTEN_SAMPLES) | (samples / rate > LISTEN_S), "too_long")


def profile_spans(start: Column, end: Column) -> Column:
    """array<struct<k, a, b>>: up to four windows of samples, spread evenly over a cue; one where it is short, none where it is empty."""
    a = F.greatest(F.lit(0), (start * PCM_RATE).cast("long"))
    span = (F.greatest(end, start) * PCM_RATE).cast("long") - a
    n = F.least(F.lit(PROFILE_WINDOWS), F.floor(span / PROFILE_WINDOW)).cast("int")
    spread = lambda k: F.floor((span - PROFILE_WINDOW) * k / F.greatest(F.lit(1), n - 1)).cast("long")
    window = lambda k, at, to: F.struct(k.cast("int").alias("k"), at.alias("a"), to.alias("b"))
    many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: window(k, a + spread(k), a + spread(k) + PROFILE_WINDOW))
    none = F.array().cast("array<struct<k:int,a:bigint,b:bigint>>")
    return F.when(span <= 0, none).when(span <= PROFILE_WINDOW, F.array(window(F.lit(0), a, a + span))).otherwise(many)


def page_language(header: Column, known=("uz", "ru", "en"), default: str = "uz") -> Column:
    codes = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda t: F.lower(F.substring(F.trim(F.split(t, ";")[0]), 1, 2)))
    return F.coalesce(F.get(F.filter(codes, lambda c: c.isin(*known)), F.lit(0)), F.lit(default))


def wants_html(accept: Column) -> Column:
    first = F.lower(F.trim(F.split(F.coalesce(accept, F.lit("*/*")), ",")[0]))
    return first.startswith("text/html") | F.contains(F.coalesce(accept, F.lit("")), F.lit("application/xhtml"))


def voice_of(roster: dict[str, list[str]], lang: Column, speaker: Column, default: str = "ru") -> Column:
    """The voice of a speaker, counted from 1 and round the roster; the first without a speaker."""
    rosters = F.create_map(*[x for k, v in roster.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    own = F.coalesce(rosters[lang], rosters[F.lit(default)])
    return F.get(own, F.when(speaker > 0, F.pmod(speaker - 1, F.size(own))).otherwise(F.lit(0)))


def merged(base: Column, patch: Column) -> Column:
    """Two maps as one, the patch's values where both have a key."""
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(patch, k), F.lit(False)))
    return F.map_concat(kept, patch)
