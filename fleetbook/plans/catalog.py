"""Registered queries: one per operator group of the inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over the fleet tables
derived from ``sf_dir``; every query reads the whole tables (a period or
tenant filter is only applied where selecting it is the feature).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetbook.sources.fixtures import TestdataTables

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
BODIES: dict[str, Callable] = {}
DOCS: dict[str, str] = {}


def query(name: str):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``tables`` is any provider of the fleet tables (``TestdataTables`` for
    the registered form, ``StagedTables`` for stored tables).
    """

    def deco(fn: Callable[[TestdataTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(TestdataTables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        BODIES[name] = fn
        DOCS[name] = (fn.__doc__ or "").strip()
        return fn

    return deco


def _load():
    # importing the modules registers their queries
    from fleetbook.plans import q_report, q_panel, q_rosters  # noqa: F401
    from fleetbook.plans import q_scalar, q_loads, q_changes, q_audit  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(REGISTRY)


def query_bodies() -> dict[str, Callable]:
    """Query bodies taking a table provider instead of a folder."""
    _load()
    return dict(BODIES)
