"""Collects the registered queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossloom.catalog.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Add a query; its comparison SQL may use the shared sub-queries."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)))
    if sql is not None:
        ORACLES[name] = sql


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    doubles = {n: F.round(n, digits) for n, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


def text(col: str, sep: str = "|"):
    """An array column as one string."""
    return F.array_join(F.col(col).cast("array<string>"), sep).alias(col)
