"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import importlib
import pkgutil
from types import ModuleType


def load() -> ModuleType:
    """Import every catalog module and return the filled registry."""
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda i: i.name):
        importlib.import_module(f"{__name__}.{info.name}")
    return importlib.import_module(f"{__name__}.registry")
