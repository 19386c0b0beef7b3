"""Queries over the driver tables: each operator bound to the tables, with its SQL twin."""

from importlib import import_module

AREAS = ["projects", "profiles", "lists", "matching", "updates", "pages", "search", "jobs", "streams", "expressions", "files"]


def all_queries() -> dict:
    """Name -> (function of Tables, SQL or None)."""
    from bidweave.plans.registry import QUERIES
    for area in AREAS:
        import_module(f"bidweave.plans.{area}")
    return dict(QUERIES)
