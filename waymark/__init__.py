"""Analytics of activities, routes and diaries on Spark."""

from __future__ import annotations

import importlib


def __getattr__(name: str):
    """The public functions, imported at first use, so that workers load only what they run."""
    if name != "__all__" and (name.startswith("_") or name == "api"):
        raise AttributeError(name)
    api = importlib.import_module("waymark.api")
    if name == "__all__":
        return list(api.__all__)
    if name in api.__all__:
        return getattr(api, name)
    raise AttributeError(name)
