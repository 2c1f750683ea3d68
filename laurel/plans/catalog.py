"""Registry of runnable queries and, where SQL can say it, their plain SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in RUNS:
            raise ValueError(f"Query {name!r} is registered twice")
        RUNS[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from laurel.plans import (  # noqa: F401
        alerts,
        attendance,
        coverage,
        evidence,
        records,
        serving,
        sources,
        streams,
        upkeep,
    )
