"""The registered queries of the reference's operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from parley.plans.registry import QUERIES, SQL

MODULES = ("metric_queries", "cluster_queries", "timeline_queries", "text_queries", "state_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"parley.plans.{name}")


def all_queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
