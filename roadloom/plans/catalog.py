"""Imports every module that registers queries."""

from __future__ import annotations

import importlib
import pkgutil

import roadloom.plans as plans


def load() -> None:
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{plans.__name__}.{m.name}")
