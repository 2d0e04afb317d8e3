"""Registered queries, grouped by operator family."""

from __future__ import annotations

import importlib

FAMILIES = ("text_checks", "draft_checks", "structure_checks", "library_checks", "page_checks", "layout_checks", "history_checks")


def all_checks():
    from quire.plans import registry

    for family in FAMILIES:
        importlib.import_module(f"quire.plans.{family}")
    return registry.QUERIES, registry.ORACLES
