"""All named queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnlake.plans import activity, history, media, problems, sources, storage, trees

MODULES = (problems, storage, trees, history, activity, media, sources)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable taking the session and the folder of the tables."""
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    """Name -> SQL giving the same rows and columns in DuckDB."""
    return {name: s for m in MODULES for name, s in m.SQL.items()}
