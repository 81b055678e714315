"""Checked queries over the driver tables, by area."""

from importlib import import_module

from tabweave.plans.catalog import ENTRIES, Entry

AREAS = ("relational", "statistics", "charts", "models")


def all_entries() -> dict[str, Entry]:
    for area in AREAS:
        import_module(f"tabweave.plans.{area}")
    return dict(ENTRIES)


def flagship(tables):
    all_entries()
    return ENTRIES["revenue_by_year"].build(tables)
