"""Queries and SQL of the library's own operators, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.plans import artifacts, lattice, relational, studies

MODULES = (lattice, relational, studies, artifacts)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
