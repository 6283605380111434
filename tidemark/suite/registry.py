"""Registration of named queries and helpers both sides of a comparison share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        @wraps(build)
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir.rstrip("/"))

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql.strip()
        return prepared

    return register


def once(build: Callable) -> Callable:
    """Run a costly step once per (application, data set); several queries read its tables."""
    results: dict[tuple[str, str], object] = {}

    @wraps(build)
    def remembered(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in results:
            results[key] = build(spark, sf_dir)
        return results[key]

    return remembered


def snap(value: Column | str, digits: int) -> Column:
    """Round half up, with a margin wider than floating-point noise, so that both engines agree."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * 10.0**digits + 0.5001) / 10.0**digits


def snap_sql(value: str, digits: int) -> str:
    return f"(floor(({value}) * 1e{digits} + 0.5001) / 1e{digits})"
