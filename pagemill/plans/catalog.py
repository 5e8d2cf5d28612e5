"""The registered queries and their oracles, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans import binary, layout, profiling, reference

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (profiling, reference, layout, binary):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
