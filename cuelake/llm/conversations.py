"""Repair of a conversation's structure by cheapest edits, found by A* on the edit lattice.

The role initials of a repaired conversation read ``(s?(ua)+)?``. A row may be kept (K, free), given the role that the pattern asks for (R, 1)
or deleted (D, 2); blank rows and repeats of a role and text seen earlier have to go; a row that stays although its text
stops without a full stop costs 5 more; a row without text may be inserted (I, 5). A node of the lattice is a number of rows read and a state of the
pattern. The search is keyed by (cost plus heuristic, audit), audit being the edits' initials so far, so the first end that is
reached has the least cost and of those the least audit. The heuristic adds up, over the rows ahead, 2 for each that has to go and 2 for each
unfinished one, which pays at least its deletion; it never falls by more than an edit costs.

A long conversation is cut into windows of ``WINDOW`` rows, searched apart from each of the four states to each other; these answers add up
like the edits themselves, ties included, because an audit that is longer for the same rows costs more. So rows without their texts are dealt by ranges of
(conversation, turn), and a conversation of any size is many windows in many tasks. Then each conversation's windows and whole rows pass a task in order, once, in
batches: windows are folded into the audit, edits and digests follow row by row. What a task holds of a conversation is its audit, one character a row,
which is a value of the result, and four bytes and text for each state and window.

Rows come by turn, nulls first; rows of one turn by a digest of role and text. A null role or text counts as one space. A conversation without rows gets
zeros and empty strings; rows with a null conv_id are one conversation; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .sharding import sql_crc32

#: Rows of a window.
WINDOW = 512
DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
#: What the pattern asks for in each state, and the state that follows: at the beginning, after s, after u, after a.
AHEAD = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
ENDS = (0, 3)
FAULTS = ("blank", "duplicate", "truncated")
WORD, CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
WINDOWS = "conv_id {0}, at long, costs array<long>, audits array<string>, counts array<long>, edge array<string>"
REPORT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id {0}, place long, edit string, turn long, role string, text string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows with the faults that a checksum of (conversation, turn) picks; dropped rows stay, marked."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    out = rows.select("conv_id", F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    return out.withColumn("kind", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows without nulls in role and text, with the digest that orders rows of one turn and tells repeats."""
    rows = rows.select("conv_id", F.col("turn").cast("long"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], "gone")
    return rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _shapes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, initial, fault (blank, duplicate, truncated or none; repeats at one turn not yet marked), without texts."""
    fault = F.when(~F.col("text").rlike(WORD), "blank").when(~F.col("text").rlike(CLOSED), "truncated")
    slim = rows.filter(~F.col("gone")).select("conv_id", "turn", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    firsts = slim.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(turn).alias("first"), F.max(turn).alias("last")).filter("first < last").select("c", "d", "first")
    joined = slim.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("first").isNotNull() & (turn > F.col("first")) & ~F.coalesce(F.col("fault") == "blank", F.lit(False))
    return joined.withColumn("fault", F.when(again, "duplicate").otherwise(F.col("fault"))).drop("c", "d", "first")


def search(rows: list[tuple[str, str | None]], state: int, goals: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """state reached -> (cost, audit) of the cheapest edits of rows (initial, fault) from a state, the least audit of those."""
    ahead = [0]
    for _, fault in reversed(rows):
        ahead.append(ahead[-1] + (DELETE if fault else 0))
    ahead.reverse()
    heap, done, found = [(ahead[0], "", 0, 0, state)], set(), {}
    while heap and len(found) < len(goals):
        _, audit, cost, at, state = heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))

        def go(edit: str, price: int, to: int, onto: int, audit: str = audit, cost: int = cost) -> None:
            if (to, onto) not in done:
                heappush(heap, (cost + price + ahead[to], audit + edit, cost + price, to, onto))

        for initial, onto in AHEAD[state].items():
            if initial in ROLES:
                go("I", INSERT, at, onto)
        if at == len(rows):
            if state in goals:
                found[state] = (cost, audit)
            continue
        own, fault = rows[at]
        go("D", DELETE, at + 1, state)
        if fault in ("blank", "duplicate"):
            continue
        charge = UNFINISHED if fault else 0
        for initial, onto in AHEAD[state].items():
            if own == initial:
                go("K", charge, at + 1, onto)
            if initial in ROLES:
                go("R", REROLE + charge, at + 1, onto)
    return found


def illegal(one: str, two: str) -> bool:
    return one + two not in ("su", "ua", "au")


def _window(conv, at: int, rows: list[tuple[str, str | None]], begins: bool, ends: bool) -> tuple:
    """A row of WINDOWS. begins, ends: whether the conversation is known to begin, to end with it."""
    costs, audits = [None] * 16, [None] * 16
    for entry in range(1 if begins else 4):
        for leave, (cost, audit) in search(rows, entry, ENDS if begins and ends else (0, 1, 2, 3)).items():
            costs[4 * entry + leave], audits[4 * entry + leave] = cost, audit
    counts = [sum(fault == name for _, fault in rows) for name in FAULTS] + [sum(illegal(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))]
    return conv, at, costs, audits, counts, [rows[0][0], rows[-1][0]]


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _searched(schema: pa.Schema) -> Callable:
    """Rows in order -> windows. A partition's first conversation may have begun before it and its last may go on behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, now, before, at, begins, first = [], [], None, None, 0, False, True
        for batch in batches:
            for conv, turn, digest, initial, fault, place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if first or conv != now:
                    if held:
                        out.append(_window(now, at, held, begins, True))
                    held, now, begins, before, first = [], conv, not first, None, False
                elif len(held) == WINDOW:
                    out.append(_window(now, at, held, begins, False))
                    held, begins = [], False
                if not held:
                    at = place
                if (turn, digest) == before and fault != "blank":
                    fault = "duplicate"
                before = (turn, digest)
                held.append((initial, fault))
            if len(out) > 1000:
                yield _out(out, schema)
                out = []
        if held:
            out.append(_window(now, at, held, begins, False))
        yield _out(out, schema)

    return run


def windows(rows: DataFrame) -> DataFrame:
    """WINDOWS of the rows that _ordered gives: for each entry state (of four) and state reached the cost and the audit, counts of faults, first and last initial."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "digest"]
    dealt = cut(_shapes(rows)).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return dealt.mapInArrow(_searched(_arrow(dealt.sparkSession, WINDOWS.format(kind))), WINDOWS.format(kind))


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema


class Folded:
    """A conversation's audit, window by window: for each state the cost and a chain of pieces, each with the chain before it."""

    def __init__(self):
        self.best: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
        self.counts, self.last = [0, 0, 0, 0], None

    @staticmethod
    def less(one: tuple | None, two: tuple | None) -> bool:
        """Whether one chain's audit is less; chains are equally long, and what they share is not looked at."""
        left, right = [], []
        while one is not two:
            left.append(one[1])
            right.append(two[1])
            one, two = one[0], two[0]
        return "".join(reversed(left)) < "".join(reversed(right))

    def _better(self, one: tuple, two: tuple | None) -> bool:
        return two is None or one[0] < two[0] or one[0] == two[0] and self.less(one[1], two[1])

    def add(self, costs: list, audits: list, counts: list, edge: list) -> None:
        after: dict[int, tuple] = {}
        for entry, (cost, chain) in self.best.items():
            for leave in range(4):
                if (more := costs[4 * entry + leave]) is not None:
                    one = (cost + more, (chain, audits[4 * entry + leave]))
                    if self._better(one, after.get(leave)):
                        after[leave] = one
        self.best = after
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.counts[3] += self.last is not None and illegal(self.last, edge[0])
        self.last = edge[1]

    def chosen(self) -> tuple[int, list[str]]:
        """(cost, pieces of the audit in order)."""
        best = None
        for state in ENDS:
            if state in self.best and self._better(self.best[state], best):
                best = self.best[state]
        pieces, chain = [], best[1]
        while chain is not None:
            pieces.append(chain[1])
            chain = chain[0]
        return best[0], pieces[::-1]


class Walk:
    """The edits of one conversation, applied to its rows as they come."""

    def __init__(self, folded: Folded):
        self.folded = folded
        self.cost, self.pieces = folded.chosen()
        self.edits = (edit for piece in self.pieces for edit in piece)
        self.state, self.place, self.digest = 0, 0, hashlib.sha256()
        self.low = self.high = self.turns = None

    def _line(self, edit: str, turn: int | None, role: str, text: str) -> tuple:
        self.digest.update(("\n" * (self.place > 0) + f"{role}:{text}").encode())
        self.place += 1
        return (self.place - 1, edit, turn, role, text)

    def _expected(self) -> str:
        wanted = next(x for x in AHEAD[self.state] if x in ROLES)
        self.state = AHEAD[self.state][wanted]
        return ROLES[wanted]

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """(place, edit, turn, role, text) of what is inserted before a row and of the row, unless it goes."""
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, (self.turns or 0) + 1
        for edit in self.edits:
            if edit == "K":
                self.state = AHEAD[self.state][role[:1]]
                yield self._line(edit, turn, role, text)
            elif edit != "D":
                yield self._line(edit, *((turn, self._expected(), text) if edit == "R" else (None, self._expected(), "")))
            if edit != "I":
                return

    def end(self) -> Iterator[tuple]:
        for edit in self.edits:
            yield self._line(edit, None, self._expected(), "")

    def report(self) -> tuple:
        gaps = 0 if self.turns is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.folded.counts, self.cost, "".join(self.pieces), self.digest.hexdigest())


def _walked(schema: pa.Schema, report: bool) -> Callable:
    """Each conversation's windows, then its rows -> one report, or the rows of the repaired conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, folded, walk, first = None, Folded(), None, True

        def finish() -> None:
            nonlocal walk
            walk = walk or Walk(folded)
            rest = [(now, *line) for line in walk.end()]
            out.extend([(now, *walk.report())] if report else rest)

        for batch in batches:
            for conv, turn, role, text, gone, costs, audits, counts, edge in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "costs", "audits", "counts", "edge")], strict=True):
                if first or conv != now:
                    if not first:
                        finish()
                    now, folded, walk, first = conv, Folded(), None, False
                if costs is not None:
                    folded.add(costs, audits, counts, edge)
                elif not gone:
                    walk = walk or Walk(folded)
                    for line in walk.row(turn, role, text):
                        if not report:
                            out.append((now, *line))
            if len(out) > 1000:
                yield _out(out, schema)
                out.clear()
        if not first:
            finish()
        yield _out(out, schema)

    return run


def _repaired(rows: DataFrame, schema: str, report: bool) -> DataFrame:
    schema = schema.format(rows.schema["conv_id"].dataType.simpleString())
    rows = _ordered(rows)
    found = windows(rows)
    both = rows.withColumns({"at": F.lit(None).cast("long"), "kind": F.lit(1)}).unionByName(found.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at", "turn", "digest").drop("digest", "kind", "at")
    return both.mapInArrow(_walked(_arrow(rows.sparkSession, schema), report), schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), turn, role, text: the rows of the repaired conversations."""
    return _repaired(conversations.select("conv_id", "turn", "role", "text", F.lit(False).alias("gone")), ROWS, False)


def reported(conversations: DataFrame) -> DataFrame:
    """REPORT for each conversation of rows with conv_id, turn, role, text and gone (rows that only name their conversation)."""
    return _repaired(conversations, REPORT, True)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


OP11_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k,
    {sql_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations
), d AS (
  SELECT k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c
), o AS (
  SELECT *, md5(length(role) || ':' || role || text) AS digest FROM d
), r AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, digest) AS i FROM o
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY k, digest ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
    i > 1 AND lag(initial) OVER (PARTITION BY k ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS bad FROM r
), keep(q, initial, onto) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), name(initial, role) AS (VALUES ('u', 'user'), ('a', 'assistant')
), edit AS (
  SELECT q, onto, 'K' AS e, 0 AS price, initial AS own, NULL AS role FROM keep
  UNION ALL SELECT q, onto, 'R', 1, NULL, role FROM keep JOIN name USING (initial)
  UNION ALL SELECT q, q, 'D', 2, NULL, NULL FROM range(4) AS z(q)
), ins(q, onto, price, e, lines) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']),
  (2, 3, 5, 'I', ['assistant:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])
), s(k, i, q, b) AS (
  SELECT k, 0::BIGINT, ins.onto, {{'cost': ins.price::BIGINT, 'audit': ins.e, 'lines': ins.lines}} FROM (SELECT DISTINCT k FROM c), ins WHERE ins.q = 0
  UNION ALL
  SELECT s.k, s.i + 1, ins.onto, min({{
    'cost': s.b.cost + edit.price + CASE WHEN f.fault = 't' AND edit.e <> 'D' THEN 5 ELSE 0 END + ins.price,
    'audit': s.b.audit || edit.e || ins.e,
    'lines': list_concat(CASE edit.e WHEN 'D' THEN s.b.lines ELSE list_append(s.b.lines, coalesce(edit.role, f.role) || ':' || f.text) END, ins.lines)}})
  FROM s JOIN f ON f.k = s.k AND f.i = s.i + 1 JOIN edit ON edit.q = s.q JOIN ins ON ins.q = edit.onto
  WHERE (edit.e = 'D' OR f.fault NOT IN ('b', 'd')) AND (edit.own IS NULL OR edit.own = f.initial)
  GROUP BY s.k, s.i, ins.onto
), n AS (
  SELECT k, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM f GROUP BY k
), e AS (
  SELECT c.conv_id, n.*, (SELECT min(b) FROM s WHERE s.k = c.k AND s.i = coalesce(n.n, 0) AND s.q IN (0, 3)) AS b FROM (SELECT DISTINCT k, conv_id FROM c) AS c LEFT JOIN n ON n.k = c.k
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.cost AS cost, b.audit AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256 FROM e
"""
