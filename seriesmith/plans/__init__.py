"""Queries over the driver tables."""

from __future__ import annotations

import importlib

_MODULES = ["window_queries", "event_queries", "evaluation_queries", "relational_queries", "source_queries", "model_queries",
            "contract_queries"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"seriesmith.plans.{name}")


def all_queries():
    from seriesmith.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from seriesmith.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
