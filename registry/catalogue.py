"""All registered queries in one table."""

from __future__ import annotations

import importlib

MODULES = ("calls", "runs", "replays", "quality", "schemas", "changes", "graphs", "assets", "policies", "tables")


def all_queries():
    found = {}
    for module in MODULES:
        for name, query in importlib.import_module(f"registry.{module}").R.items.items():
            if name in found:
                raise ValueError(f"{name} is registered twice")
            found[name] = query
    return found
