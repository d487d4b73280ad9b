"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data_queries, more_queries, sky_queries  # noqa: F401  (more_queries adds to the queries of sky_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**data_queries.QUERIES, **sky_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**data_queries.SQL, **sky_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sky_queries.tangent_search(spark, sf_dir)
