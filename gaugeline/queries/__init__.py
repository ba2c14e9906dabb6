"""Queries over the given tables, one module per area."""

import importlib

MODULES = ("check_queries", "text_queries", "grounding_queries", "runlog_queries", "source_queries")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"gaugeline.queries.{name}")
