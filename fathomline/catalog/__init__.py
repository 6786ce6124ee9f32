"""All named queries in one place."""

from __future__ import annotations

from importlib import import_module

from fathomline.catalog.base import Catalog

PARTS = ("rows", "tables", "models", "tracks", "condition", "platform")


def everything() -> Catalog:
    whole = Catalog()
    for part in PARTS:
        catalog = import_module(f"fathomline.catalog.{part}").C
        for name, fn in catalog.queries.items():
            whole.add(name, catalog.sql.get(name))(fn)
    return whole
