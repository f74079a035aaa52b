"""Whole-table jobs and the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("feature_queries", "race_queries", "feed_queries", "text_queries", "stream_queries")


def _load():
    for module in MODULES:
        import_module(f"laplake.plans.{module}")
    return import_module("laplake.plans.registry")


def all_queries() -> dict[str, Callable]:
    return dict(_load().QUERIES)


def oracle_statements() -> dict[str, str]:
    return dict(_load().ORACLES)
