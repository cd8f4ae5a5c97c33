"""Registered queries over the given tables, with their SQL oracles."""

from importlib import import_module

# one module per part of the inventory
MODULES = ("production", "admission", "alarms", "lifecycle", "signals", "records", "day_tables", "dead_letters", "dataflow", "streams")


def load():
    """Import every query module and return the catalog."""
    for name in MODULES:
        import_module(f"millwright.plans.{name}")
    return import_module("millwright.plans.catalog")
