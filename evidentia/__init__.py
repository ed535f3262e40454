"""Evidentia: a Spark-first engine for document evidence, registers and retrieval.

The public names are those of evidentia.api; they load when one is asked for, so
that workers import only what they run.
"""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"


def __getattr__(name: str) -> object:
    if not name.startswith("_"):
        api = import_module("evidentia.api")
        if name in getattr(api, "__all__", ()):  # none while it is loading
            return getattr(api, name)
    raise AttributeError(f"module 'evidentia' has no attribute '{name}'")


def __dir__() -> list[str]:
    return import_module("evidentia.api").__all__
