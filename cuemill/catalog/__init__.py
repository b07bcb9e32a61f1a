"""Registered queries with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> dict:
    """Import every catalog module and return the registry."""
    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
    from cuemill.catalog.base import REGISTRY

    return REGISTRY
