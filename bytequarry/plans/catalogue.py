"""Queries over the driver's tables, by name, each with SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Registers a query function under ``name``, with its SQL."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


from bytequarry.plans import carve_queries, codec_queries, inspect_queries, relational_queries, stat_queries, window_queries  # noqa: E402, F401  (registers its queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["classify_region"](spark, sf_dir)
