"""Registered queries, grouped by topic."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package once, which fills the registry."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
