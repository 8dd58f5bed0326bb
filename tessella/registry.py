"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES: tuple[str, ...] = (
    "tessella.operators.vector",
    "tessella.operators.spatial",
    "tessella.operators.lookup",
    "tessella.operators.raster",
    "tessella.operators.tools",
    "tessella.operators.quadtree",
    "tessella.operators.outlines",
    "tessella.operators.dissolve",
    "tessella.operators.fill",
    "tessella.operators.identify",
    "tessella.operators.partition",
    "tessella.operators.views",
    "tessella.sources.clustered",
    "tessella.sources.region",
    "tessella.sources.arrays",
    "tessella.sources.dataset",
    "tessella.functions.arcs",
    "tessella.plans.planner",
    "tessella.plans.chain",
    "tessella.plans.pyramid",
    "tessella.streaming.events",
    "tessella.streaming.loading",
)


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(m).ORACLE_SQL.items()}
