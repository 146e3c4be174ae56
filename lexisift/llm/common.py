"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisift.sources.shared import stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with an ending that none of ``columns`` has, for columns added for a while."""
    taken, end = {c.lower() for c in columns}, ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]
