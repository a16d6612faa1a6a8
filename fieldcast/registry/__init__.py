"""Registered queries, one module per family; importing a module registers its queries."""

from __future__ import annotations

from importlib import import_module

FAMILIES = [
    "scalar_queries", "window_queries", "aggregate_queries", "index_queries", "join_queries", "terrain_queries",
    "quality_queries", "source_queries", "model_queries", "feature_queries", "advisory_queries", "report_queries",
]


def load() -> tuple[dict, dict]:
    from fieldcast.registry import base

    for family in FAMILIES:
        import_module(f"fieldcast.registry.{family}")
    return base.QUERIES, base.ORACLES
