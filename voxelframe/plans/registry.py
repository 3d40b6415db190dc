"""The queries of the library over the driver's tables, with their SQL: every plans module adds its own."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import voxelframe.plans as plans

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_"))
    return [importlib.import_module(f"{plans.__name__}.{n}") for n in names]


def queries() -> dict[str, Query]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
