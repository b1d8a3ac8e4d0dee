"""All queries of the library by the name of their operator, with the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..sources.adapters import Tables, with_ctes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan over the domain's tables under its operator's name."""

    def register(plan: Callable[[Tables], DataFrame]):
        _QUERIES[name] = plan
        if sql is not None:
            _SQL[name] = with_ctes(sql)
        return plan

    return register


def _load() -> None:
    from . import analytics, relational, replay  # noqa: F401


def _bound(plan: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plan(Tables(ship(spark), sf_dir))

    return run


def queries() -> dict[str, Query]:
    _load()
    return {name: _bound(plan) for name, plan in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
