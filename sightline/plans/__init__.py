"""Registered queries and their check SQL."""

from __future__ import annotations

from importlib import import_module

from sightline.plans.catalog import CHECKS, QUERIES

MODULES = ("report_queries", "gallery_queries", "detection_queries", "stream_queries", "store_queries", "source_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"sightline.plans.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_checks():
    _load()
    return dict(CHECKS)
