"""The catalogue of named queries: each is a function (spark, sf_dir) with, where SQL can say it, DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES = (
    "tessera.plans.relational",
    "tessera.functions.strings",
    "tessera.functions.maths",
    "tessera.functions.dates",
    "tessera.functions.collections",
    "tessera.functions.aggregates",
    "tessera.functions.udfs",
    "tessera.operators.relational",
    "tessera.operators.strategies",
    "tessera.plans.benchmarks",
    "tessera.plans.rewrites",
    "tessera.plans.coverage",
    "tessera.sources.tables",
    "tessera.streaming.windows",
    "tessera.streaming.joins",
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
