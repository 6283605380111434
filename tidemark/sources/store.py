"""Stored tables: enriched events and window results, Parquet partitioned by date.

``joined_events``   event_date / batch_id
``window_results``  window_date / batch_id
``window_index``    for each batch of results the dates it wrote and its newest emission

A batch overwrites only its own (date, batch) folders, so a repeated batch replaces what its
first attempt wrote. Window results are appended; a later write of the same (window, version)
wins when the table is read, and ``compact_windows`` folds the copies away.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.times import Windows, micros, timestamp
from tidemark.operators.corrections import latest
from tidemark.operators.windows import unpacked
from tidemark.plans.durable import dated, folders, remove, write_text, written
from tidemark.plans.sizing import left_join
from tidemark.schemas import FACT_COLUMNS, JOINED_EVENTS, WINDOW_RESULTS

RESULT_COLUMNS = WINDOW_RESULTS.fieldNames()
_BATCH = T.StructField("batch_id", T.LongType())


class Store:
    """The two tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.events_path = f"{root.rstrip('/')}/joined_events"
        self.windows_path = f"{root.rstrip('/')}/window_results"
        self.index_path = f"{root.rstrip('/')}/window_index"

    # -- reading -------------------------------------------------------------------------------

    def joined_events(self) -> DataFrame:
        """Stored events with ``event_date``; no rows when nothing was stored yet."""
        return self._read(self.events_path, JOINED_EVENTS, "event_date").drop("batch_id")

    def window_writes(self, days: Iterable[date] | None = None) -> DataFrame:
        """Every stored copy of every window result, or of those that start on some dates."""
        if days is None:
            return self._read(self.windows_path, WINDOW_RESULTS, "window_date")
        schema = _with_partitions(WINDOW_RESULTS, "window_date")
        return dated(self.spark, self.windows_path, schema, "window_date", days)

    def window_results(self) -> DataFrame:
        """One row per (window, correction version): the last one written."""
        return self.dated_results().select(*RESULT_COLUMNS)

    def dated_results(self) -> DataFrame:
        """Window results with ``window_date``; a filter on it reads only those dates."""
        return _last_written(self.window_writes())

    def _read(self, path: str, layout: T.StructType, day: str) -> DataFrame:
        schema = _with_partitions(layout, day)
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def register(self) -> None:
        """Make both tables known to SQL under their names, with the date columns that prune them, and the table
        function ``windows_at(instant)``: the newest correction of each window that contains an instant."""
        self.joined_events().createOrReplaceTempView("joined_events")
        self.dated_results().createOrReplaceTempView("window_results")
        layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in WINDOW_RESULTS.fields)
        columns = [f"newest.{name}" for name in RESULT_COLUMNS if name != "window_id"]
        # No result starts on a date after the instant.
        self.spark.sql(
            f"""CREATE OR REPLACE TEMPORARY FUNCTION windows_at(instant TIMESTAMP) RETURNS TABLE ({layout}) RETURN
            SELECT window_id, {', '.join(columns)} FROM (
              SELECT window_id, max_by(struct(*), correction_version) AS newest FROM window_results
              WHERE window_date <= CAST(instant AS DATE) AND window_start <= instant AND window_end > instant
              GROUP BY window_id)"""
        )

    # -- writing -------------------------------------------------------------------------------

    def add_events(self, joined: DataFrame, batch_id: int, created_at: str = "ingest_time") -> None:
        self._write(
            joined_rows(joined, created_at).withColumn("event_date", F.to_date("event_time")),
            self.events_path,
            "event_date",
            batch_id,
            ["event_id", "join_key"],
        )

    def add_windows(self, results: DataFrame, batch_id: int) -> None:
        seen = Observation(f"windows-{uuid.uuid4().hex}")
        rows = results.select(*RESULT_COLUMNS).observe(seen, F.max(micros("emitted_at")).alias("newest"))
        self._write(
            rows.withColumn("window_date", F.to_date("window_start")), self.windows_path, "window_date", batch_id
        )
        days = [x[1] for x in self._dated_folders(f"batch_id={batch_id}")]
        newest = seen.get.get("newest") if days else None
        if newest is not None:
            text = "\n".join(json.dumps({"window_date": str(day), "newest_us": newest}) for day in days)
            write_text(self.spark, f"{self.index_path}/batch-{batch_id}.json", text)

    def _dated_folders(self, batch: str = "batch_id=*") -> list[tuple[str, date, int]]:
        """(path, date, batch) of the stored folders of window results, from a listing alone."""
        found = []
        for name in folders(self.spark, f"{self.windows_path}/window_date=*/{batch}"):
            part = re.search(r"window_date=(\d{4}-\d\d-\d\d)/batch_id=(\d+)$", name)
            if part:
                found.append((name, date.fromisoformat(part[1]), int(part[2])))
        return found

    def _write(
        self, rows: DataFrame, path: str, day: str, batch_id: int, sought: Sequence[str] = ()
    ) -> None:
        """Columns in ``sought`` get Bloom filters, so a search for some of their values skips the row groups
        without them; the adaptive kind takes no more room than a column's values ask for."""
        # Rebalancing by date keeps the files per date few, and splits a date that is very large.
        writer = (
            rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .hint("rebalance", day)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
        )
        if sought:
            writer = writer.option("parquet.bloom.filter.adaptive.enabled", True)
        for name in sought:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", True)
        writer.partitionBy(day, "batch_id").parquet(path)

    def compact_windows(self) -> None:
        """Fold the copies of each window result into one per (window, version).

        The result replaces the newest batch folder of each date that has several; the others are
        dropped. A crash half way leaves extra copies, which reading removes anyway. Run it
        between batches.
        """
        writes = self.window_writes()
        batches: dict[date, list[int]] = {}
        for _, day, batch in self._dated_folders():
            batches.setdefault(day, []).append(batch)
        newest = {day: max(found) for day, found in batches.items() if len(found) > 1}
        if not newest:
            return
        # One row per stored date.
        targets = F.broadcast(
            self.spark.createDataFrame(list(newest.items()), "window_date date, _newest bigint")
        )
        folded = (
            writes.join(targets, "window_date")
            .groupBy("window_date", "_newest", "window_id", "correction_version")
            .agg(F.max_by(F.struct(*_payload()), "batch_id").alias("_row"))
            .select(
                "window_id",
                "correction_version",
                "_row.*",
                "window_date",
                F.col("_newest").alias("batch_id"),
            )
        )
        (
            written(folded, "compacted")
            .select(*RESULT_COLUMNS, "window_date", "batch_id")
            .hint("rebalance", "window_date")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("window_date", "batch_id")
            .parquet(self.windows_path)
        )
        for day, keep in newest.items():
            for batch in batches[day]:
                if batch != keep:
                    remove(self.spark, f"{self.windows_path}/window_date={day}/batch_id={batch}")

    # -- retention and statistics --------------------------------------------------------------

    def drop_before(self, cutoff: datetime) -> int:
        """Delete events with event_time < cutoff and windows with window_end < cutoff.

        Folders that lie wholly before the cutoff are dropped; only those the cutoff cuts are
        rewritten. Returns the rows deleted.
        """
        events = self._read(self.events_path, JOINED_EVENTS, "event_date")
        return self._drop(events, self.events_path, "event_date", "event_time", cutoff) + (
            self._drop(
                self.window_writes(), self.windows_path, "window_date", "window_end", cutoff
            )
        )

    def _drop(self, rows: DataFrame, path: str, day: str, column: str, cutoff: datetime) -> int:
        old = F.col(column) < F.lit(cutoff)
        # A row that old can only lie in a folder dated at or before the cutoff.
        rows = rows.filter(F.col(day) <= F.lit(cutoff.date()))
        counts = F.count("*").alias("n"), F.count_if(old).alias("n_old")
        # One row per stored date that has old rows reaches the driver.
        days = rows.groupBy(day).agg(*counts).filter("n_old > 0").collect()
        cut = sorted(row[day] for row in days if row.n_old < row.n)
        if cut:
            # Only on the dates that the cutoff cuts, batch folders matter one by one.
            here = rows.filter(F.col(day).isin(cut))
            gone = here.groupBy(day, "batch_id").agg(*counts).filter("n_old = n").collect()
            kept = written(here.filter(~old), "retained")
            (
                kept.hint("rebalance", day)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(day, "batch_id")
                .parquet(path)
            )
            for row in gone:
                remove(self.spark, f"{path}/{day}={row[day]}/batch_id={row.batch_id}")
        for row in days:
            if row.n_old == row.n:
                remove(self.spark, f"{path}/{day}={row[day]}")
        return sum(row.n_old for row in days)

    def stats(self) -> DataFrame:
        events = self.joined_events().agg(F.count("*").alias("n_rows"))
        windows = self.window_results().agg(F.count("*").alias("n_rows"))
        return events.select(F.lit("joined_events").alias("table_name"), "n_rows").unionByName(
            windows.select(F.lit("window_results").alias("table_name"), "n_rows")
        )

    # -- queries -------------------------------------------------------------------------------

    def latest_windows(self, limit: int = 100) -> DataFrame:
        """The newest results by emission; several versions of one window may appear.

        Dates are read in order of their newest emission, more and more of them, until the last of the results
        is newer than anything on the dates that are left.
        """
        days = self._newest_dates()
        take = 2
        while True:
            read = days[:take]
            rows = _last_written(self.window_writes([day for _, day in read])).select(*RESULT_COLUMNS)
            found = newest_results(rows, limit)
            if take >= len(days):
                return found
            last = found.agg(F.min(micros("emitted_at")), F.count("*")).first()
            if last[1] == limit and last[0] > days[take][0]:
                return found
            take *= 2

    def _newest_dates(self) -> list[tuple[float, date]]:
        """(newest emission at most, date) of the stored dates, the newest first; one row per date.

        A date that the index does not know comes first.
        """
        known: dict[date, float] = {}
        if folders(self.spark, f"{self.index_path}/*.json"):
            index = self.spark.read.schema("window_date date, newest_us long").json(self.index_path)
            rows = index.groupBy("window_date").agg(F.max("newest_us").alias("newest_us")).collect()
            known = {row["window_date"]: row["newest_us"] for row in rows}
        stored = {day for _, day, _ in self._dated_folders()}
        return sorted(((known.get(day, float("inf")), day) for day in stored), reverse=True)

    def windows_at(self, instant: datetime, longest_seconds: int | None = None) -> DataFrame:
        """Newest correction of each window that contains the instant.

        No date after the instant is read, and none before the start of the longest window that
        can contain it, where ``longest_seconds`` tells.
        """
        rows = self.dated_results().filter(F.col("window_date") <= F.lit(instant.date()))
        if longest_seconds is not None:
            first = (instant - timedelta(seconds=longest_seconds)).date()
            rows = rows.filter(F.col("window_date") >= F.lit(first))
        return windows_at(rows.select(*RESULT_COLUMNS), instant)

    def events_between(
        self, start: datetime, end: datetime, event_ids: Sequence[str] | None = None
    ) -> DataFrame:
        """Stored events with start <= event_time < end; dates outside are never read."""
        rows = self.joined_events().filter(
            F.col("event_date").between(F.lit(start.date()), F.lit(end.date()))
            & (F.col("event_time") >= F.lit(start))
            & (F.col("event_time") < F.lit(end))
        )
        return rows if event_ids is None else rows.filter(F.col("event_id").isin(list(event_ids)))


    def events_by(self, column: str, values: Sequence[str]) -> DataFrame:
        """Stored events with one of a few values of ``event_id`` or ``join_key``, of whatever date.

        Every file's footer is asked; row groups whose Bloom filters rule the values out are not read.
        """
        return self.joined_events().filter(F.col(column).isin(list(values)))


def _with_partitions(layout: T.StructType, day: str) -> T.StructType:
    return T.StructType([*layout.fields, T.StructField(day, T.DateType()), _BATCH])


def _payload() -> list[str]:
    return [c for c in RESULT_COLUMNS if c not in ("window_id", "correction_version")]


def _last_written(writes: DataFrame) -> DataFrame:
    # A window's id stands for its bounds and date; grouping by them too lets filters on them reach
    # the scan.
    bounds = ["window_start", "window_end"]
    rest = [name for name in _payload() if name not in bounds]
    return (
        writes.groupBy("window_date", *bounds, "window_id", "correction_version")
        .agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
        .select("window_id", *bounds, "correction_version", "_row.*", "window_date")
        .select(*RESULT_COLUMNS, "window_date")
    )


def joined_rows(joined: DataFrame, created_at: str = "ingest_time") -> DataFrame:
    """Enriched events in the stored layout: every column beyond the envelope goes to
    ``dimension_attrs_json``, nulls kept."""
    extra = [name for name in joined.columns if name not in FACT_COLUMNS]
    attributes = (
        F.to_json(F.struct(*extra), {"ignoreNullFields": "false"}) if extra else F.lit("{}")
    )
    return joined.select(
        "event_id",
        "event_time",
        "ingest_time",
        "join_key",
        "payload_json",
        attributes.alias("dimension_attrs_json"),
        "source_topic",
        F.col("partition").cast("int").alias("partition_id"),
        F.col("offset").cast("bigint").alias("offset_id"),
        F.col(created_at).alias("created_at"),
    )


def newest_results(results: DataFrame, limit: int = 100) -> DataFrame:
    return results.orderBy(F.desc("emitted_at"), "window_id", "correction_version").limit(limit)


def windows_at(results: DataFrame, instant: datetime) -> DataFrame:
    inside = (F.col("window_start") <= F.lit(instant)) & (F.col("window_end") > F.lit(instant))
    return latest(results.filter(inside))


def windows_at_many(
    results: DataFrame, instants: DataFrame, windows: Windows, at: str = "instant"
) -> DataFrame:
    """Newest correction of each window containing each row's instant.

    The starts of the windows that contain an instant are known, so the range condition becomes
    an equi join on the window start.
    """
    us = micros(at)
    wanted = instants.withColumn(
        "window_start",
        F.explode(
            F.transform(
                windows.starts(windows.first_start(us), windows.last_start(us)),
                lambda start: timestamp(start),
            )
        ),
    )
    found = left_join(wanted, latest(results), ["window_start"], spread=instants.columns)
    return found.filter(F.col("window_id").isNotNull())


def expanded(results: DataFrame) -> DataFrame:
    """Results with ``aggregations`` as a map instead of text."""
    return results.withColumn("aggregations", unpacked("aggregations_json")).drop(
        "aggregations_json"
    )


def metrics_of(results: DataFrame) -> DataFrame:
    """One row per (result, metric)."""
    rows = expanded(results)
    keep = [c for c in rows.columns if c != "aggregations"]
    return rows.select(*keep, F.explode("aggregations").alias("metric", "metric_value"))
