"""Registered queries of the engine: name -> plan and name -> reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cuelake.sources.model import Views, check_sql

MODULES = ("ledger", "jobs", "timedtext", "signal", "script", "cutlaws", "speech", "dubbing", "streams", "checks", "changes", "validation", "sqltexts", "captions")

_PLANS: dict[str, Callable[[Views], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a plan over the model's views, with the SQL that checks it where SQL can."""

    def keep(plan: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        assert name not in _PLANS, name
        _PLANS[name] = plan
        if sql:
            _CHECKS[name] = check_sql(sql)
        return plan

    return keep


def _load() -> None:
    for m in MODULES:
        import_module(f"cuelake.plans.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _PLANS["usage_summary"](Views(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: lambda spark, sf_dir, plan=plan: plan(Views(spark, sf_dir)) for name, plan in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_CHECKS)
