"""Registered queries and their oracle SQL, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from passagework.cluster import ship
from passagework.plans import legal_queries, pair_queries, retrieval_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def shipped(query: Query) -> Query:
    """The query, after the package is on the executors."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (text_queries, retrieval_queries, pair_queries, legal_queries):
    QUERIES.update({name: shipped(f) for name, f in _module.QUERIES.items()})
    ORACLES.update(_module.ORACLES)
