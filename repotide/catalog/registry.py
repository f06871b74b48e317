"""Registered queries: name -> (Spark job, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repotide.fixtures import with_views

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Job], Job]:
    """Register a job under ``name``; ``oracle`` is DuckDB SQL with the same column names."""

    def add(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = job
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return job

    return add
