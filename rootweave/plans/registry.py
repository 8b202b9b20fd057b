"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rootweave.plans import graph_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **graph_queries.QUERIES}
ORACLE: dict[str, str] = {**text_queries.ORACLE, **graph_queries.ORACLE}
