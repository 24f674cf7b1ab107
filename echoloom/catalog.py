"""The library's queries over the given tables and the SQL that each is checked against."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans


def _modules() -> list:
    return [importlib.import_module(f"{plans.__name__}.{m.name}") for m in pkgutil.iter_modules(plans.__path__)]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
