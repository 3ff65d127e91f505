"""Loads every catalog module, which registers its queries."""

from __future__ import annotations

import importlib

from labelq.catalog.base import ORACLES, QUERIES

MODULES = ("prep", "results", "scans", "noise", "metrics", "neighbours", "detectors", "series", "learning")


def load():
    for name in MODULES:
        importlib.import_module(f"labelq.catalog.{name}")
    return QUERIES, ORACLES
