"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = ("views", "effects", "records", "statistics", "planning", "streams")


def load():
    """Import every contract module once; returns (queries, oracle SQL)."""
    for name in MODULES:
        importlib.import_module(f"pairlens.contract.{name}")
    from pairlens.contract.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)


# Queries are composed as they register, so the shared views come first whatever is imported.
importlib.import_module("pairlens.contract.views")
