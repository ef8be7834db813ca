"""Imports every query module so that the registry is complete."""

import importlib
import pkgutil

from tidewatch import plans
from tidewatch.plans.registry import REGISTRY, Query, Tables, query, run, tidy  # noqa: F401

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module.startswith("q_"):
        importlib.import_module(f"tidewatch.plans.{_module}")
