"""What running queries report of each batch, as a table.

A listener takes Spark's own account of every micro-batch: rows, time of each step, rows dropped by the
watermark and size of the state. Each is one small file under ``path``, named by query and batch, so a batch
that is run again replaces its row.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.plans.durable import make_folder, write_text

REPORT = (
    "query string, batch_id long, n_rows long, trigger_ms long, steps_ms map<string, long>, "
    "state_rows long, state_bytes long, late_rows_dropped long, watermark string"
)


class BatchReports(StreamingQueryListener):
    """Register with ``spark.streams.addListener``; only queries whose name starts with ``prefix`` are reported."""

    def __init__(self, spark: SparkSession, path: str, prefix: str = ""):
        self.spark, self.path, self.prefix = spark, path.rstrip("/"), prefix
        make_folder(spark, self.path)
        self.open: set[str] = set()

    def onQueryStarted(self, event) -> None:
        if (event.name or "").startswith(self.prefix):
            self.open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if not (told.name or "").startswith(self.prefix):
            return
        steps = dict(told.durationMs)
        row = {
            "query": told.name,
            "batch_id": told.batchId,
            "n_rows": told.numInputRows,
            "trigger_ms": steps.get("triggerExecution"),
            "steps_ms": steps,
            "state_rows": sum(x.numRowsTotal for x in told.stateOperators),
            "state_bytes": sum(x.memoryUsedBytes for x in told.stateOperators),
            "late_rows_dropped": sum(x.numRowsDroppedByWatermark for x in told.stateOperators),
            "watermark": told.eventTime.get("watermark") if told.eventTime else None,
        }
        write_text(self.spark, f"{self.path}/{told.name or 'query'}-{told.batchId:09d}.json", json.dumps(row))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.open.discard(str(event.runId))

    def wait(self, seconds: float = 30) -> bool:
        """Until the reports of ended queries are in: they come a little after the end. False if they did not."""
        until = time.monotonic() + seconds
        while self.open and time.monotonic() < until:
            time.sleep(0.05)
        return not self.open

    def table(self) -> DataFrame:
        """One row per (query, batch)."""
        return self.spark.read.schema(REPORT).json(self.path)
