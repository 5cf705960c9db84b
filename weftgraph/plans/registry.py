"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code_queries, index_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**table_queries.QUERIES, **code_queries.QUERIES, **index_queries.QUERIES}
ORACLES: dict[str, str] = {**table_queries.ORACLES, **code_queries.ORACLES, **index_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["cy_flagship"](spark, sf_dir)
