"""Glossary terms in texts: one pass, longest first, whole words, any case."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import AT_ONCE, in_python

#: Most characters out, and most growth.
MOST_OUT, GROWTH, SLACK = 200_000, 4, 4096


def replacer(terms: dict[str, str]) -> Callable[[str], str]:
    """Replaces terms in one pass, so a replacement is never matched again; the text itself where the result would be too long."""
    keys = sorted((k for k in terms if k), key=lambda k: (-len(k), k.lower(), k))
    if not keys:
        return lambda text: text
    to: dict[str, str] = {}
    for k in keys:
        to.setdefault(k.lower(), terms[k])
    found = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, keys))})(?!\w)", re.IGNORECASE)

    def run(text: str) -> str:
        out = found.sub(lambda m: to.get(m[0].lower(), m[0]), text)
        return text if len(out) > min(MOST_OUT, GROWTH * len(text) + SLACK) else out

    return run


def replace_terms(text: str, terms: dict[str, str]) -> str:
    return replacer(terms)(text)


def masker(terms: dict[str, str]) -> Callable[[str], tuple[str, dict[str, str]]]:
    """Makes marks of the terms found, longest term first, and returns the marks' meanings."""
    known = [(re.compile(rf"(?<!\w){re.escape(k)}(?!\w)", re.IGNORECASE), f"⟦T{i}⟧", terms[k]) for i, k in enumerate(sorted((k for k in terms if k), key=len, reverse=True))]

    def run(text: str) -> tuple[str, dict[str, str]]:
        marks: dict[str, str] = {}
        for found, mark, meaning in known:
            text, n = found.subn(mark, text)
            if n:
                marks[mark] = meaning
        return text, marks

    return run


def mask_terms(text: str, terms: dict[str, str]) -> tuple[str, dict[str, str]]:
    return masker(terms)(text)


def applied(text: Column, terms: dict[str, str]) -> Column:
    return in_python(replacer(terms))(text)


def masked(text: Column, terms: dict[str, str]) -> Column:
    """struct(text, marks). A few texts are Python objects at a time, the others lie in Arrow buffers."""

    def run(texts: pa.Array) -> pa.Array:
        mask, parts = masker(terms), []
        kind = pa.struct([("text", pa.string()), ("marks", pa.map_(pa.string(), pa.string()))])
        for at in range(0, len(texts), AT_ONCE):
            rows = [mask(t or "") for t in texts.slice(at, AT_ONCE).to_pylist()]
            parts.append(pa.array([{"text": t, "marks": list(m.items())} for t, m in rows], kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, "text string, marks map<string,string>")(text)


def unmasked(text: Column, marks: Column) -> Column:
    return F.aggregate(F.map_entries(marks), text, lambda t, e: F.replace(t, e.key, e.value))


def hits(text: Column, terms: Column) -> Column:
    """Those of an array of terms that occur in the text, in any case."""
    return F.filter(terms, lambda t: (t != "") & F.contains(F.lower(text), F.lower(t)))
