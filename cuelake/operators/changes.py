"""State of tables that are only appended to: rows are changes, and what holds now is an aggregate over them.

Everything that a mutable table would do by an update is one of a few reductions: the last change of a key wins, the first one wins, a mark
is set once, a deletion hides what came before it. They are partial aggregates, so a key with very many changes is reduced before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Changes of a key whose states are followed one by one in a row of the first aggregation.
CHUNK = 4096

#: Which changes a job takes in which state, and the state that follows.
JOB_MACHINE = {
    "claim": {"queued": "running"},
    "finish": {"running": "done"},
    "fail": {"running": "failed"},
    "cancel": {"queued": "canceled"},
    "retry": {"failed": "queued", "canceled": "queued"},
}
JOB_STATES = ("queued", "running", "done", "failed", "canceled")


def last_wins(changes: DataFrame, keys: list[str], order: str, op: str = "op", deleted: str = "delete") -> DataFrame:
    """keys and the other columns of each key's last change; none where that is a deletion."""
    rest = [c for c in changes.columns if c not in (*keys, order, op)]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(op, *rest), order).alias("last"))
    return last.filter(F.col(f"last.{op}") != deleted).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def cleared(changes: DataFrame, keys: list[str], owner: str, order: str, op: str = "op", deleted: str = "delete", clear: str = "clear") -> DataFrame:
    """As ``last_wins``, where a change ``clear`` also deletes all that its owner had before it."""
    clears = changes.filter(F.col(op) == clear).groupBy(F.col(owner).alias("_owner")).agg(F.max(order).alias("_cleared"))
    own = changes.filter(F.col(op) != clear)
    live = last_wins(own.withColumn("_order", F.col(order)), keys, order, op, deleted)
    kept = live.join(clears, F.col(owner) == F.col("_owner"), "left").filter(F.col("_cleared").isNull() | (F.col("_order") > F.col("_cleared")))
    return kept.drop("_owner", "_cleared", "_order")


def patched(changes: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """key and, for each field, the last value that a change gave it; null leaves a field as it was."""
    return changes.groupBy(key).agg(*[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, the order number of the first row of each and how many later ones are refused; rows with a null key are all taken."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    alone = rows.filter(~known).select(*keys, F.col(order).alias("taken"), F.lit(0).cast("long").alias("refused"))
    return rows.filter(known).groupBy(*keys).agg(F.min(order).alias("taken"), (F.count("*") - 1).alias("refused")).unionByName(alone)


def set_once(marks: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys and the first time that each was marked."""
    return marks.groupBy(*keys).agg(F.min(at).alias(at))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among those of ``gone``."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def states(changes: DataFrame, key: str, order: str, op: str, machine: dict[str, dict[str, str]], names: tuple[str, ...], start: str, chunk: int = CHUNK) -> DataFrame:
    """key, status and how many changes were taken, where a change is taken only in the states that allow it (compare and set).

    What a run of changes does is a map from states to (state, changes taken), and maps compose. So a key's changes, numbered
    by ``order``, are cut into runs of that many numbers; each run becomes a map in one aggregation, and a second one composes a key's maps. A
    key with a third of all changes is so many short rows, never one long one.
    """
    step = F.create_map(*[x for o, t in machine.items() for a, b in t.items() for x in (F.lit(f"{o}:{a}"), F.lit(b))])
    first = F.array(*[F.struct(F.lit(n).alias("status"), F.lit(0).cast("long").alias("taken")) for n in names])

    def one(at: Column, o: Column) -> Column:
        to = F.element_at(step, F.concat(o, F.lit(":"), at.status))
        return F.when(to.isNotNull(), F.struct(to.alias("status"), (at.taken + 1).alias("taken"))).otherwise(at)

    run = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(op).alias("op"))))
    runs = changes.groupBy(key, F.floor(F.col(order) / chunk).alias("_run")).agg(run.alias("ops"))
    maps = runs.select(key, "_run", F.aggregate("ops", first, lambda acc, e: F.transform(acc, lambda at: one(at, e.op))).alias("map"))
    place = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])

    def then(at: Column, e: Column) -> Column:
        to = F.get(e.map, F.element_at(place, at.status))
        return F.struct(to.status.alias("status"), (at.taken + to.taken).alias("taken"))

    whole = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_run", "map"))).alias("maps"))
    begin = F.struct(F.lit(start).alias("status"), F.lit(0).cast("long").alias("taken"))
    return whole.select(key, F.aggregate("maps", begin, then).alias("s")).select(key, "s.status", "s.taken")


def retries(requests: DataFrame, jobs: DataFrame, allowed: tuple[str, ...] = ("failed", "canceled")) -> DataFrame:
    """Ledger rows of retry requests: each is charged first; the minutes of one that doesn't win the claim come back.

    The first request of a job in an allowed state wins. requests: id, job_id; jobs: id, user_id, status, minutes.
    """
    asked = requests.join(jobs.select(F.col("id").alias("job_id"), "user_id", "status", "minutes"), "job_id")
    winner = asked.filter(F.col("status").isin(*allowed)).groupBy("job_id").agg(F.min("id").alias("winner"))
    asked = asked.join(winner, "job_id", "left")
    lost = F.col("winner").isNull() | (F.col("id") != F.col("winner"))
    entry = lambda sign, reason: F.struct((F.lit(sign) * F.col("minutes")).alias("delta"), F.lit(reason).alias("reason"))
    rows = F.filter(F.array(entry(-1, "job:retry"), F.when(lost, entry(1, "refund:retry"))), lambda e: e.isNotNull())
    return asked.select("id", "job_id", "user_id", F.explode(rows).alias("e")).select("id", "job_id", "user_id", "e.*")


def charges(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows for jobs that were not charged yet: user, minus the minutes, the job as reference."""
    done = ledger.filter("reason = 'job'").select(F.col("ref").alias("_ref"))
    rows = jobs.select("user_id", (-F.col("minutes")).alias("delta"), F.lit("job").alias("reason"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("ref"))
    return rows.join(done, F.col("ref") == F.col("_ref"), "left_anti")


def recovered(jobs: DataFrame, active: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """Jobs that a restart found active, as they become: failed, with the minutes to give back."""
    return jobs.filter(F.col("status").isin(*active)).select("id", "user_id", F.lit("failed").alias("status"), F.col("minutes").alias("refund"))


def batches(files: DataFrame, most: int = 10) -> DataFrame:
    """batch, how many files are taken, and the answer: 201 all, 207 some, 422 none or too many. files: batch, code ('ok' or what refuses it)."""
    rows = files.groupBy("batch").agg(F.count("*").alias("files"), F.count_if(F.col("code") == "ok").alias("ok"))
    taken = F.when(F.col("files") > most, 0).otherwise(F.col("ok"))
    answer = F.when((F.col("files") > most) | (F.col("ok") == 0), 422).when(F.col("ok") == F.col("files"), 201).otherwise(207)
    return rows.select("batch", "files", taken.alias("taken"), answer.alias("answer"))


def merged_list(kept: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``kept`` with those of ``seen`` in their place where keys agree, and seen ones that are new in front. Same columns."""
    both = kept.withColumn("_new", F.lit(0)).unionByName(seen.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key)
    rows = both.withColumns({"_top": F.max("_new").over(w), "_old": F.min("_new").over(w)}).filter(F.col("_new") == F.col("_top"))
    return rows.select(*kept.columns, (F.col("_old") == 1).alias("in_front")).orderBy(F.desc("in_front"), order)
