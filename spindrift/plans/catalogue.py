"""Queries by name, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in CATALOGUE:
            raise ValueError(f"two queries are named {name}")
        CATALOGUE[name] = Query(run, sql)
        return run

    return add


def load() -> dict[str, Query]:
    """All queries; the modules register them."""
    from . import queries_maintenance, queries_quality, queries_retrieval, queries_text  # noqa: F401

    return CATALOGUE
