"""The registered queries over the engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import graph, retrieval, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text.QUERIES, **retrieval.QUERIES, **graph.QUERIES}
SQL: dict[str, str] = {**text.SQL, **retrieval.SQL, **graph.SQL}
