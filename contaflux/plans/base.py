"""How queries and their DuckDB twins are registered, and money in SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contaflux.plans.domain import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
YEAR = 1996
#: The day that stands for now.
TODAY = datetime.date(1997, 1, 1)


def add(name: str, views: str, build: Callable[..., DataFrame], oracle: str | None = None) -> None:
    """A query that passes the named domain views to build, and its SQL over the same views."""
    names = views.split()
    QUERIES[name] = lambda spark, sf_dir: build(*(view(spark, sf_dir, n) for n in names))
    if oracle:
        ORACLES[name] = with_views(views, oracle)


def add_raw(name: str, table: str, build: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    """A query over a stored table."""
    QUERIES[name] = lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
    if oracle:
        ORACLES[name] = oracle


def cents(x: str) -> str:
    return f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)"


def round2(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100.0::DOUBLE)"


def euro(x: str) -> str:
    return f"(CAST({x} AS DOUBLE) / 100.0::DOUBLE)"
