"""Registration of this subpackage's queries, and the session settings its operators rely on."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import INITIAL_PARTITIONS, prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SETTINGS = {
    # Arrow batches go by bytes: a record may hold a whole text of any length.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.python.filterPushdown.enabled": "true",
}
# For several operators in a row on executors whose memory is short: Python workers give memory back to the
# system instead of keeping what their largest batch took, and scans hold fewer texts at a time.
FRUGAL_ENVIRONMENT = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "1",
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(8 << 20),
}
FRUGAL_SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": "512"}
ROOT = str(Path(__file__).resolve().parents[2])


def configured(spark: SparkSession) -> SparkSession:
    """``spark`` with these settings, its Python workers able to import this library in place."""
    prepare(spark)
    # Text operators are measured with shuffles of spark.sql.shuffle.partitions.
    spark.conf.unset(INITIAL_PARTITIONS)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
    return spark


def frugal(spark: SparkSession) -> SparkSession:
    """``configured``, with less memory beside the JVM's heap."""
    for key, value in FRUGAL_SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in FRUGAL_ENVIRONMENT.items():
        spark.sparkContext.environment.setdefault(key, value)
    return configured(spark)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        @wraps(build)
        def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configured(spark), sf_dir.rstrip("/"))

        QUERIES[name] = ready
        if sql is not None:
            ORACLES[name] = sql.strip()
        return ready

    return register
