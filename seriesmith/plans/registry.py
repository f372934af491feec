"""Registry of the queries bound to the driver tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesmith.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = functools.wraps(fn)(run)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round for the exact comparison with SQL; adding 0.0 turns -0.0 into 0.0."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})
