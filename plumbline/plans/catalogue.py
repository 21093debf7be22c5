"""The catalogue of registered queries over the fixture tables."""
from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return keep


MODULES = ("relational", "series", "corpora", "evaluation", "records", "streams", "storage", "controls", "audits")


def _load() -> None:
    for name in MODULES:
        import_module(f"plumbline.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, how many risk events an alarm anticipated."""
    return queries()["e_anticipated_events"](spark, sf_dir)
