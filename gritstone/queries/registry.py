"""All queries of the engine with their SQL, gathered from the modules beside this one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = ("relational", "resolution", "sequences", "text", "similarity", "mutation", "scalars", "streams", "people", "lookups")
MODULES = tuple(importlib.import_module(f"gritstone.queries.{name}") for name in NAMES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.Q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.Q.sql.items()}
