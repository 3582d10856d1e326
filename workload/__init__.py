"""Named queries over the standard tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("preparation", "shaping", "measures", "statistics", "modelling", "tuning", "streams")


def _load():
    for m in MODULES:
        importlib.import_module(f"workload.{m}")
    from workload import base

    return base


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict:
    return dict(_load().ORACLES)
