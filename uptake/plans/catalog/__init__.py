"""Named queries over the driver tables, each with its checking SQL if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..driver_views import Facts, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(facts) -> DataFrame`` under ``name`` with its oracle."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Facts(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return register


from . import code, inference, metrics, quality, registry, reports, text  # noqa: E402,F401
