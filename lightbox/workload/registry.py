"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lightbox.fixtures import Library, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a function of a :class:`Library` under ``name``.

    ``sql`` is the equivalent statement for the check engine; library views it
    names are inlined, ``views`` adds further ones.
    """

    def register(fn: Callable[[Library], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Library(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = check_sql(sql, views)
        return fn

    return register
