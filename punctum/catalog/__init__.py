"""Queries of the general operators over the test tables, each with SQL that must give the same rows."""

from importlib import import_module

_PARTS = ("relational", "spatial", "detection", "profiles", "statistics", "subtypes", "simulation", "sweeps")


def collected() -> tuple[dict, dict]:
    """All queries and all SQL of the parts."""
    queries, sql = {}, {}
    for name in _PARTS:
        part = import_module(f"punctum.catalog.{name}")
        queries |= part.QUERIES
        sql |= part.SQL
    return queries, sql
