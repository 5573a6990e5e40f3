"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

import lossloom.plans as plans
from lossloom.plans.registry import REGISTRY

for _m in sorted(m.name for m in iter_modules(plans.__path__) if m.name.startswith("q_")):
    import_module(f"lossloom.plans.{_m}")

__all__ = ["REGISTRY"]
