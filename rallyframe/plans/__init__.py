"""Registry of queries over the tracking tables."""
from __future__ import annotations

import importlib

MODULES = ["q_scalars", "q_tracking", "q_stats", "q_sequences", "q_state", "q_narrative", "q_streaming", "q_files"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"rallyframe.plans.{m}")


def all_queries():
    _load()
    from rallyframe.plans.registry import QUERIES
    return dict(QUERIES)


def all_oracles():
    _load()
    from rallyframe.plans.registry import oracles
    return oracles()


def coverage():
    _load()
    from rallyframe.plans.registry import COVERS
    return dict(COVERS)
