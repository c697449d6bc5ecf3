"""The named queries."""

from __future__ import annotations

import importlib

from . import registry

GROUPS = ["retrieval", "corpus", "turns"]


def load():
    """(queries, SQL) of all groups."""
    for group in GROUPS:
        importlib.import_module(f"{__name__}.{group}")
    return registry.QUERIES, registry.ORACLE
