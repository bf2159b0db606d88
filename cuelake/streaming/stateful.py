"""Folds over ordered events of a key: sliding admission, breakers, balances, block feeds.

Each decision depends on the ones before it, so a key's events go to one task in order. Tables pass by ``fold``, batch by batch, so a key of any
size holds its state only; streams keep their state by ``applyInPandasWithState``.
"""

from __future__ import annotations

import hashlib
import hmac
from collections import deque
from collections.abc import Iterable, Iterator
from urllib.parse import parse_qsl

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuelake.operators.ordered import fold

#: The breaker's failures in a row and its cooldown.
FAILURES, COOLDOWN_S = 5, 60.0
#: Frames that a slow client's queue holds; how long a ticket and a sign-in stand, and how far one may lie ahead.
QUEUE, TICKET_TTL, SIGN_IN_S, AHEAD_S = 64, "15 seconds", 6 * 3600, 90


def admit_fold(at: Iterable[float], seconds: float, most: int, kept: deque | None = None) -> tuple[list[bool], deque]:
    """Whether each hit is let in: fewer than ``most`` admitted ones lie in the window before it. Only admitted hits count."""
    kept = deque() if kept is None else kept
    out = []
    for t in at:
        while kept and kept[0] <= t - seconds:
            kept.popleft()
        ok = len(kept) < most
        if ok:
            kept.append(float(t))
        out.append(ok)
    return out, kept


def admitted(hits: DataFrame, seconds: float, most: int) -> DataFrame:
    """id, key, admitted. hits: id, key, at (timestamp). Hits of one moment go by id."""
    timed = hits.select("id", "key", (F.unix_micros("at") / 1e6).alias("t"))
    step = lambda kept, row: (admit_fold([row["t"]], seconds, most, kept)[0][0],)
    return fold(timed, ["key"], ["t", "id"], deque, step, "admitted boolean").select("id", "key", "admitted")


class Breaker:
    """Failures in a row, and since when calls are refused."""

    def __init__(self, failures: int = FAILURES, cooldown: float = COOLDOWN_S):
        self.failures, self.cooldown, self.run, self.since = failures, cooldown, 0, None

    def call(self, t: float, failed: bool) -> str:
        """closed, open (refused) or half_open (tried after the cooldown)."""
        trial = self.since is not None
        if trial and t - self.since < self.cooldown:
            return "open"
        self.run = self.run + 1 if failed else 0
        if not failed:
            self.since = None
        elif trial or self.run >= self.failures:
            self.since = t
        return "half_open" if trial else "closed"


def breaker(calls: DataFrame) -> DataFrame:
    """id, key, state. calls: id, key, at (timestamp), failed."""
    timed = calls.select("id", "key", "failed", (F.unix_micros("at") / 1e6).alias("t"))
    return fold(timed, ["key"], ["t", "id"], Breaker, lambda b, row: (b.call(row["t"], row["failed"]),), "state string").select("id", "key", "state")


def _spend(purse: dict, row: dict) -> tuple[bool, int]:
    """Credits always count; a debit counts only where the balance covers it."""
    after = purse.get("has", 0) + row["d"]
    fine = row["d"] >= 0 or after >= 0
    if fine:
        purse["has"] = after
    return fine, purse.get("has", 0)


def spends(ledger: DataFrame) -> DataFrame:
    """id, user_id, counted, balance: debits admitted in the order of ids. Sums are of ten-thousandths, so they are exact.

    Which debits are refused rests on those before, so a user's rows pass one task in order; what it holds is one number, whatever
    the number of rows.
    """
    exact = ledger.select("id", "user_id", (F.col("delta") * 10_000).cast("long").alias("d"))
    rows = fold(exact, ["user_id"], ["id"], dict, _spend, "counted boolean, has long")
    return rows.select("id", "user_id", "counted", (F.col("has") / 10_000).alias("balance"))


def admitted_stream(hits: DataFrame, seconds: float, most: int, late: str | None = None) -> DataFrame:
    """The same admission over a stream of (id, key, at): a key's state is the times of its admitted hits in the window.

    With ``late``, how far hits may lag, later ones are left out, and once the watermark has passed a key's window its state goes: no hit that still
    counts could see it. Without it nothing is too late, so state is kept for every key.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(chunks)).sort_values(["t", "id"], kind="stable")
        ok, kept = admit_fold(rows["t"].to_numpy(), seconds, most, kept)
        state.update((list(kept),))
        ends = max([*kept, float(rows["t"].max())]) + seconds
        if late:
            state.setTimeoutTimestamp(max(int(ends * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"], "key": rows["key"], "admitted": ok})

    timed = (hits.withWatermark("at", late) if late else hits).select("id", "key", *["at"] * bool(late), (F.unix_micros("at") / 1e6).alias("t"))
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    return timed.groupBy("key").applyInPandasWithState(run, "id long, key long, admitted boolean", "times array<double>", "append", timeout)


def feed_blocks(blocks: DataFrame, frame: int) -> DataFrame:
    """RMS levels from a stream of (tape, block, pcm: 16-bit little-endian bytes): whole frames only; what is left of a block waits for the next.

    Levels don't depend on how a tape was cut into blocks. A block without bytes (null) ends its tape, and the tape's state goes.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, f = state.get if state.exists else (b"", 0)
        rows = pd.concat(list(chunks)).sort_values("block")
        ended = rows["pcm"].isna().any()
        data = bytes(carry) + b"".join(rows["pcm"].dropna())
        n = len(data) // (2 * frame)
        x = np.frombuffer(data[: n * 2 * frame], dtype="<i2").astype(np.float64).reshape(n, frame)
        level = np.sqrt((x * x).sum(axis=1) / frame) / 32768.0
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((data[n * 2 * frame :], int(f) + n))
        yield pd.DataFrame({"tape": key[0], "f": np.arange(int(f), int(f) + n, dtype=np.int64), "level": level})

    return blocks.groupBy("tape").applyInPandasWithState(run, "tape long, f long, level double", "carry binary, f long", "append", GroupStateTimeout.NoTimeout)


def single_use(events: DataFrame, keys: list[str], at: str, ttl: str) -> DataFrame:
    """The first event of each key within the time to live; later ones are refused."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def terminal_notices(events: DataFrame, hooks: DataFrame, steps: list[str]) -> DataFrame:
    """Stream-static join: each terminal event with the hooks of its user. hooks: user_id, webhook_id, event."""
    done = events.filter(F.col("step").isin(steps))
    return done.join(hooks, (done.user_id == hooks.user_id) & (done.step == hooks.event)).select(done.id, done.user_id, "step", "webhook_id")


def counted_per_window(events: DataFrame, at: str, watermark: str, width: str, *keys: str) -> DataFrame:
    """Events per key and window of event time; rows later than the watermark are left out."""
    return events.withWatermark(at, watermark).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))


def delivered(frames: DataFrame, drains: str, most: int = QUEUE) -> DataFrame:
    """Frames (key, at, id) with delivered: a queue takes the first ``most`` frames between two drains of it and drops the others. For tables.

    ``drains`` is the width of the window between drains. Numbers within a window come from a window function over (key, window), which Spark
    has on tables only; ``counted_per_window`` says on a stream how many a queue drops.
    """
    w = Window.partitionBy("key", F.window("at", drains).getField("start")).orderBy("at", "id")
    return frames.select("id", "key", (F.row_number().over(w) <= most).alias("delivered"))


def fanned_out(events: DataFrame, jobs: DataFrame, hooks: DataFrame, progress: Column, terminal: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """What an event sets off, as rows id, user_id, kind, target: a frame for its user, and if it ends the job a notice and a call of each hook.

    Joins with tables that stand still, so it runs on a stream as on a table. events: id, job_id, step; jobs: id, user_id; hooks: id, user_id, events.
    """
    rows = events.join(jobs.select(F.col("id").alias("job_id"), "user_id"), "job_id")
    frames = rows.select("id", "user_id", F.lit("frame").alias("kind"), progress.cast("string").alias("target"))
    ends = rows.filter(F.col("step").isin(*terminal))
    notices = ends.select("id", "user_id", F.lit("notice").alias("kind"), F.concat(F.lit("job_"), F.col("step")).alias("target"))
    names = F.transform(F.split("events", ","), lambda x: F.trim(x))
    own = hooks.select(F.col("user_id").alias("_owner"), F.col("id").alias("_hook"), names.alias("_names"))
    calls = ends.join(own, (F.col("user_id") == F.col("_owner")) & F.array_contains("_names", F.col("step")))
    calls = calls.select("id", "user_id", F.lit("call").alias("kind"), F.col("_hook").cast("string").alias("target"))
    return frames.unionByName(notices).unionByName(calls)


def signed(requests: DataFrame, token: str, now: Column) -> DataFrame:
    """requests (id, data) with user and code: a query string is taken if its hash is the keyed digest of its sorted fields and its time fits.

    Spark has no keyed digest, so that step runs on Arrow batches.
    """

    def run(data: pd.Series) -> pd.DataFrame:
        key = hmac.new(b"WebAppData", token.encode(), hashlib.sha256).digest()
        out = []
        for text in data:
            fields = dict(parse_qsl(text or "", keep_blank_values=True))
            told = fields.pop("hash", "")
            lines = "\n".join(f"{k}={fields[k]}" for k in sorted(fields))
            good = bool(told) and hmac.compare_digest(hmac.new(key, lines.encode(), hashlib.sha256).hexdigest(), told)
            out.append((good, fields.get("auth_date"), fields.get("user")))
        return pd.DataFrame(out, columns=["good", "at", "user"])

    read = F.pandas_udf(run, "good boolean, at string, user string")
    rows = requests.withColumn("_r", read("data")).withColumn("_at", F.col("_r.at").try_cast("long"))
    user = F.get_json_object("_r.user", "$.id")
    age = now - F.col("_at")
    code = (
        F.when(F.col("_at").isNull(), "no_time").when(age < -AHEAD_S, "from_the_future").when(age > SIGN_IN_S, "too_old").when(~F.col("_r.good"), "bad_hash")
        .when(user.isNull(), "no_user")
    )
    return rows.select("id", user.alias("user"), F.col("_at").alias("at"), code.alias("code"))


def used_once(sign_ins: DataFrame) -> DataFrame:
    """Good sign-ins (id, user, at, code) with fresh: the first of each (user, at); on a stream use ``single_use`` with these keys."""
    good = sign_ins.filter("code IS NULL")
    first = good.groupBy("user", "at").agg(F.min("id").alias("_first"))
    return good.join(first, ["user", "at"]).select("id", "user", "at", (F.col("id") == F.col("_first")).alias("fresh"))
