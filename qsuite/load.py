"""Import every query module, so that all queries are registered."""

from __future__ import annotations

import importlib
import pkgutil

import qsuite


def load_all() -> None:
    for module in pkgutil.iter_modules(qsuite.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"qsuite.{module.name}")
