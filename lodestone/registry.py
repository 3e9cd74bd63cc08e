"""Every query of the reference's operators by name, with SQL to compare it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.queries import events, files, graph, reports, scripts, search, text

_MODULES = [graph, text, search, events, scripts, reports, files]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
FLAGSHIP = "g01_neighborhood"
