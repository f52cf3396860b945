"""The query registry."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from galeframe.plans.oracle import with_views

Plan = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "projections", "filters", "joining", "series", "aggregates", "cleaning", "scoring", "exploration", "modelling",
    "scanning", "workflows", "sequences",
)

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}
#: Queries of whole windows, whose results are by far the largest.
WINDOWS: set[str] = set()


def query(name: str, sql: str | None = None, by: str = "user") -> Callable[[Plan], Plan]:
    """Registers a plan; ``sql`` is its oracle over the canonical views with sites per ``by``."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if plan.__module__.endswith(".sequences"):
            WINDOWS.add(name)
        if sql is not None:
            SQL[name] = with_views(sql, by)
        return plan

    return register


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"galeframe.plans.{name}")
