"""Names of the library's queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import numeric_queries, relational_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**relational_queries.QUERIES, **numeric_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**relational_queries.SQL, **numeric_queries.SQL}
