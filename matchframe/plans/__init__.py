"""Demonstration queries over the given tables."""

from __future__ import annotations

import importlib

_MODULES = ["matchlog", "bodies", "linking", "temporal", "squadlog", "form", "rated", "goalmodels", "evaluation"]


def all_queries() -> dict:
    for name in _MODULES:
        importlib.import_module(f"matchframe.plans.{name}")
    from matchframe.plans.registry import QUERIES

    return QUERIES
