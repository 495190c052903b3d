"""Registered queries over the stand-in views."""

from __future__ import annotations

import importlib

MODULES = ["box_queries", "text_queries", "manifest_queries", "sampling_queries", "match_queries", "io_queries"]


def load():
    for m in MODULES:
        importlib.import_module(f"catalog.{m}")
    from catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
