"""Table functions for SQL texts: ``FROM t, LATERAL tokens(t.text)``.

They run in Python, row by row, for those who write SQL; ``timedtext.parse_srt`` and ``cutlaws.junction_rows`` give the same rows in generated code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from cuelake.functions.timecode import TIMECODE

_STAMP = re.compile(TIMECODE)


def seconds(stamp: str) -> float:
    h, m, s, part = (int(x) for x in re.split(r"[:,.]", stamp))
    return (h * 3_600_000 + m * 60_000 + s * 1000 + part) / 1000.0


class Tokens:
    """pos (from 0), token: what lies between white space."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from enumerate(re.findall(r"\S+", text or ""))


class ParseSrt:
    """pos, idx, start, end, text: the cues of a subtitle file."""

    def eval(self, body: str) -> Iterator[tuple]:
        pos = 0
        for block in re.split(r"\n\s*\n", (body or "").strip(" \t\r\n")):
            lines = [x for x in re.split(r"\r\n|\n|\r", block) if x.strip(" \t\r\x0b\x0c")]
            at = next((k for k, x in enumerate(lines[:2]) if _STAMP.search(x)), None)
            stamps = [m[0] for m in _STAMP.finditer(lines[at])] if at is not None else []
            if len(stamps) == 2:
                named = at == 1 and re.fullmatch(r"[0-9]+", lines[0].strip(" "))
                yield pos, int(lines[0]) if named else pos + 1, seconds(stamps[0]), seconds(stamps[1]), "\n".join(lines[at + 1 :])
                pos += 1


class IllegalCuts:
    """k (the number of words before the cut), faults: junctions of a text at which a cut breaks a law."""

    def eval(self, text: str) -> Iterator[tuple]:
        from cuelake.operators.repair import fault_count

        words = re.findall(r"\S+", text or "")
        for k in range(1, len(words)):
            if faults := fault_count(words[k - 1], words[k]):
                yield k, faults


TABLES = {
    "tokens": (Tokens, "pos int, token string"),
    "parse_srt": (ParseSrt, "pos int, idx int, start double, end double, text string"),
    "illegal_cuts": (IllegalCuts, "k int, faults int"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    for name, (handler, schema) in TABLES.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
