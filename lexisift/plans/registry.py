"""The registered queries of the library proper and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return keep


from lexisift.plans import cleaning, combined, duplicates, ensembles, frequencies, integration, models, segmentation, statistics, surface, synthesis, vocabularies, web  # noqa: E402, F401
