"""Registered queries with the SQL that states the same result."""

from __future__ import annotations

import importlib

MODULES = ("records", "labs", "scores", "survival", "intervals", "association", "trajectories")


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"cohortspark.catalog.{module}")
