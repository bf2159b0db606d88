"""Flag files brought up to date: JSON texts as VARIANT, so what is in them decides, not how it is written.

Every known flag is there afterwards: one that is missing, or is no object, gets its default; one that still has the exact object an older release
stored as the default gets the new one; all others, and flags that are not known, stay as they are. A text that is no JSON object counts as empty.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flags with their defaults, and objects that older releases stored.
DEFAULTS = {name: {"enabled": True, "min_plan": "free", "pct": 100} for name in ("job_sharing", "api_keys", "webhook_out", "batch_jobs", "uzbek_language_engine")}
STALE = {"webhook_out": {"enabled": False, "min_plan": "studio", "pct": 0}, "batch_jobs": {"enabled": False, "min_plan": "studio", "pct": 10}}


def _is(value: Column, stored: dict) -> Column:
    """Whether an object is the stored one: the same names and values, whatever their order."""
    parts = F.from_json(F.to_json(value), "map<string,string>")
    same = F.size(parts) == len(stored)
    for name, x in stored.items():
        kind, shown = ("boolean", "BOOLEAN") if isinstance(x, bool) else ("double", "BIGINT|DOUBLE|FLOAT|DECIMAL.*") if isinstance(x, int) else ("string", "STRING")
        part = F.try_variant_get(value, f"$.{name}", "variant")
        same &= F.coalesce(F.schema_of_variant(part).rlike(f"^({shown})$") & (F.try_variant_get(value, f"$.{name}", kind) == F.lit(x)), F.lit(False))
    return same


def reconciled(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, flag, value (JSON, names in order), origin: kept, default, coerced (was no object) or upgraded (was an old default). files: key, text."""
    rows = files.select(F.col(key).alias("k"), F.try_parse_json(text).alias("v"))
    own = files.sparkSession.sql("SELECT k, e.key AS flag, e.value AS value FROM {rows} AS r, LATERAL variant_explode(r.v) AS e WHERE e.key IS NOT NULL", rows=rows)
    shape = F.schema_of_variant("value").startswith("OBJECT")
    known, origin, value = F.col("flag").isin(*DEFAULTS), F.lit("kept"), F.to_json("value")
    for name, old in STALE.items():
        origin = F.when((F.col("flag") == name) & _is(F.col("value"), old), "upgraded").otherwise(origin)
    origin = F.when(known & ~shape, "coerced").otherwise(origin)
    defaults = files.sparkSession.createDataFrame([(n, json.dumps(d, separators=(",", ":"))) for n, d in DEFAULTS.items()], "flag string, value string")
    given = own.select("k", "flag", F.when(origin == "kept", value).alias("value"), origin.alias("origin"), F.lit(1).alias("rank"))
    every = rows.select("k").distinct().crossJoin(F.broadcast(defaults))  # as many rows a file as there are flags
    every = every.select("k", "flag", "value", F.lit("default").alias("origin"), F.lit(0).alias("rank"))
    best = given.unionByName(every).groupBy("k", "flag").agg(F.max_by("value", "rank").alias("own"), F.min_by("value", "rank").alias("first"), F.max_by("origin", "rank").alias("origin"))
    return best.select(F.col("k").alias(key), "flag", F.coalesce("own", "first").alias("value"), "origin")
