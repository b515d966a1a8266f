"""The registered queries, by area."""

from importlib import import_module

from gumshoe.catalog.registry import ORACLE, QUERIES

AREAS = ("graph", "scalars", "analysis", "searching", "accounts", "upkeep", "stores")


def load():
    for area in AREAS:
        import_module(f"gumshoe.catalog.{area}")
    return QUERIES, ORACLE
