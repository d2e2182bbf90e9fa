"""Queries over the given tables, grouped by theme."""

from importlib import import_module

THEMES = ["problems", "sequences", "entities", "behaviour", "payloads", "evidence", "archive"]


def all_registries():
    return [import_module(f"tidelog.plans.{t}").R for t in THEMES]
