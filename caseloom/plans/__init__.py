"""Logical plans: the registered queries."""

from __future__ import annotations

from .registry import Registry


def registries() -> list[Registry]:
    """The registries of the core, in order."""
    from . import core, dates

    return [dates.REGISTRY, core.REGISTRY]
