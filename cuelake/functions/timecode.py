"""Times as columns: integer milliseconds inside, one division at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a timecode with hours; comma or point before the milliseconds.
TIMECODE = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"


def _clock(ms: Column, point: str) -> Column:
    # div by literals keeps this in generated code
    h, m, s = F.floor(ms / 3_600_000), F.floor(ms % 3_600_000 / 60_000), F.floor(ms % 60_000 / 1000)
    return F.format_string(f"%02d:%02d:%02d{point}%03d", h, m, s, (ms % 1000).cast("long"))


def to_ms(seconds: Column) -> Column:
    """Milliseconds, halves to even."""
    return F.rint(seconds * 1000).cast("long")


def srt_time(seconds: Column) -> Column:
    return _clock(to_ms(seconds), ",")


def vtt_time(seconds: Column) -> Column:
    return _clock(F.greatest(F.lit(0), to_ms(seconds)), ".")


def _hundredths(x: Column) -> Column:
    """The whole number nearest to 100 x, halves to even, of what a double from 0 to 60 holds exactly.

    The product is rounded itself, which makes halves of what lies beside them; there the error of the product, found by splitting x into
    halves of its digits, decides.
    """
    p, c = x * 100.0, x * 134217729.0
    high = c - (c - x)
    error = (high * 100.0 - p) + (x - high) * 100.0
    return F.when(p - F.floor(p) != 0.5, F.rint(p)).when(error > 0, F.ceil(p)).when(error < 0, F.floor(p)).otherwise(F.rint(p)).cast("long")


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc, the seconds rounded by themselves as printf rounds them, halves to even (they can show 60.00)."""
    cs = _hundredths(seconds % 60)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(cs / 100), cs % 100)


def parse_time(text: Column) -> Column:
    """Seconds of the first timecode in a text; its last field counts as milliseconds as written."""
    part = lambda k: F.regexp_extract(text, TIMECODE, k).cast("bigint")
    return (part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + part(4)) / F.lit(1000.0)
