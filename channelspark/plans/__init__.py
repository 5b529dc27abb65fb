"""Registered queries: operators bound to the given tables, each with its SQL check."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``queries_*`` module so that it registers its queries."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module}")
