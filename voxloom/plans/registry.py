"""All core queries by operator id, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxloom.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name; ``sql`` is its twin over the tables and derived views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def load() -> None:
    """Imports every module that registers queries."""
    from voxloom.plans import connectivity, features, graphs, mapping, prediction, skeletons, synapses, tables, volumes  # noqa: F401
