"""Registered queries over the given tables and their SQL counterparts."""

from __future__ import annotations

import importlib

from runsieve.catalog.registry import ORACLES, QUERIES, Query

_MODULES = ("scoring", "aggregates", "lifecycle", "ingest", "judging", "results", "dispatching", "streams", "keyed")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"runsieve.catalog.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
