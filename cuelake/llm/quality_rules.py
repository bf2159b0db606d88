"""Quality rules as a short-circuit cascade.

A document is kept if it passes every rule, so their order changes the cost but never the result. Each rule's cost and
selectivity (the share of documents it rejects) are measured on a bounded sample, and the rules run in the order of rejection
per cost; a document leaves at its first failure. The base counts are part of the output and are made
for every document; the other features are made only when a rule first asks for them.

The sample is about ``SAMPLE`` rows, those with the least hashes of the id, at most as many from one task; rules are timed where the rows lie, and
only sums leave a task. The sample sets the order alone.

Defined results: null text has no words; a document without words fails the base rule; rows that share a doc_id are
judged each for itself; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SAMPLE = 256
LAST = (1 << 63) - 1
#: The symbols counted, and white space.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
#: Marks that begin the lines of a list.
MARKS = "-*•‣·"


class Features:
    """Counts of one text; those beyond the base are made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.encode().split()
        self.n_words = len(self.words)
        self.word_chars = len(self.text) - sum(map(self.text.count, SPACE))
        self.n_symbols = sum(map(self.text.count, SYMBOLS))
        self.n_dup_lines = self._dup_lines()
        self.n_repeat_words = self._repeat_words()
        self._made: dict[str, float] = {}

    def _dup_lines(self) -> int:
        if "\n" not in self.text:
            return 0
        lines = [x for x in self.text.split("\n") if x.strip(SPACE)]
        return len(lines) - len(set(lines))

    def _repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in self.words), dtype=np.int64, count=n)
        if len(ids) == n:
            return 0
        # two steps keep the window key within 63 bits however many words there are
        pair = w[:-1] * len(ids) + w[1:]
        if len(ids) > 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * len(ids) + w[2:]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):
            covered[shift : shift + len(twice)] |= twice
        return int(covered.sum())

    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words

    def get(self, name: str, make: Callable[[Features], float]) -> float:
        if name not in self._made:
            self._made[name] = make(self)
        return self._made[name]


def _upper(f: Features) -> float:
    letters = [c for c in f.text if c.isalpha()]
    return sum(map(str.isupper, letters)) / max(1, len(letters))


def _lines(f: Features) -> float:
    return sum(1 for x in f.text.split("\n") if x.strip(SPACE))


def _top_word(f: Features) -> float:
    return Counter(f.words).most_common(1)[0][1] / f.n_words if f.words else 0.0


def _top_pair(f: Features) -> float:
    """Share of the words that the commonest pair of neighbours takes."""
    pairs = Counter(zip(f.words, f.words[1:], strict=False))
    return 2 * max(pairs.values(), default=0) / max(1, f.n_words)


def _letterless(f: Features) -> float:
    return sum(1 for w in f.text.split() if not (w.isalpha() or any(map(str.isalpha, w)))) / max(1, f.n_words)


def _line_starts(f: Features) -> float:
    """Share of the lines with words that begin with a list mark."""
    lines = [x for x in f.text.split("\n") if x.strip(SPACE)]
    return sum(x.strip(SPACE)[0] in MARKS for x in lines) / max(1, len(lines))


def _line_ends(f: Features) -> float:
    """Share of the lines with words that break off in dots."""
    lines = [x for x in f.text.split("\n") if x.strip(SPACE)]
    return sum(x.rstrip(SPACE).endswith(("...", "…")) for x in lines) / max(1, len(lines))


def _repeated_fives(f: Features) -> float:
    """Share of the five-word windows that occur earlier in the text."""
    fives = list(zip(*(f.words[k:] for k in range(5)), strict=False))
    return 1 - len(set(fives)) / max(1, len(fives)) if fives else 0.0


def _packed(f: Features) -> float:
    """Bytes of the text after compression for each byte before."""
    raw = f.text.encode()
    return len(zlib.compress(raw, 1)) / max(1, len(raw))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Features], bool]


#: The rules of the production query; each is true where the document is to go.
RULES = (
    Rule("mean_word_length", lambda f: not 2.5 <= f.word_chars / max(1, f.n_words) <= 12),
    Rule("symbols_per_word", lambda f: f.n_symbols > 0.1 * f.n_words),
    Rule("exclamations_per_word", lambda f: f.text.count("!") > 0.3 * f.n_words),
    Rule("upper_case_share", lambda f: f.get("upper", _upper) > 0.5),
    Rule("duplicate_line_share", lambda f: f.n_dup_lines > 0 and f.n_dup_lines > 0.6 * f.get("lines", _lines)),
    Rule("one_word_share", lambda f: f.get("top_word", _top_word) > 0.4),
    Rule("one_pair_share", lambda f: f.get("top_pair", _top_pair) > 0.4),
    Rule("letterless_word_share", lambda f: f.get("letterless", _letterless) > 0.4),
    Rule("list_line_share", lambda f: f.get("starts", _line_starts) > 0.9),
    Rule("broken_line_share", lambda f: f.get("ends", _line_ends) > 0.5),
    Rule("repeated_five_words", lambda f: f.n_repeat_words > 0 and f.get("fives", _repeated_fives) > 0.4),
    Rule("compressibility", lambda f: f.get("packed", _packed) < 0.08),
)


def measure(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """rule -> (seconds a document, share rejected) on about ``sample`` documents that pass the base rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, failed, n = np.zeros(len(rules)), np.zeros(len(rules), dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if n >= sample:
                    break
                seen = Features(text.as_py())
                if seen.base_failed():
                    continue
                n += 1
                for k, rule in enumerate(rules):
                    seen._made.clear()
                    began = time.perf_counter()
                    failed[k] += bool(rule.fails(seen))
                    spent[k] += time.perf_counter() - began
        cols = (np.arange(len(rules), dtype=np.int32), spent, failed, np.full(len(rules), n))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rule", "s", "failed", "n"])

    count = docs.count()
    few = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= F.lit(min(LAST, LAST * sample // max(1, count)))
    per = docs.filter(few).select("text").mapInArrow(run, "rule int, s double, failed long, n long").groupBy("rule")
    sums = per.agg(F.sum("s").alias("s"), F.sum("failed").alias("failed"), F.sum("n").alias("n")).collect()
    found = {r["rule"]: (r["s"] / r["n"], r["failed"] / r["n"]) for r in sums if r["n"]}
    return {rule.name: found.get(k, (0.0, 0.0)) for k, rule in enumerate(rules)}


def order_rules(measured: dict[str, tuple[float, float]], rules=RULES) -> list[Rule]:
    """Most rejection per cost first; ties in the given order."""
    rank = lambda r: -measured[r.name][1] / max(measured[r.name][0], 1e-9)
    return sorted(rules, key=rank)


def judge(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and failed_rule: the first that failed in the cascade's order."""
    ordered = order_rules(measure(docs, rules, sample), rules)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                f = Features(text.as_py())
                base = f.base_failed()
                failed = "base" if base else next((r.name for r in ordered if r.fails(f)), None)
                out.append((*(getattr(f, x) for x in fields), base, failed is None, failed))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", *fields, "base_failed", "kept", "failed_rule"],
            )

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in fields) + ", base_failed boolean, kept boolean, failed_rule string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents", "doc_id", "text")).drop("failed_rule")
