"""All registered queries of the statistical toolkit, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mixtura.plans import clustering, relational, scalar, testing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (testing, scalar, relational, clustering):
    QUERIES.update(_module.REGISTRY.queries)
    ORACLE_SQL.update(_module.REGISTRY.sql)
