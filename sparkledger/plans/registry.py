"""Queries by name, each with the statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the views of :mod:`sparkledger.plans.views`."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def load_all() -> None:
    """Import every query module once."""
    from . import (  # noqa: F401
        q_coding,
        q_events,
        q_extract,
        q_history,
        q_matching,
        q_profiles,
        q_quality,
        q_standard,
        q_streams,
    )
