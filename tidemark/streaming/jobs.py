"""The live form of the operators.

``Flow`` is the whole job in two streaming queries. The first decodes: dead letters, enriched events, late
events, and per batch one row for each (pane, field) that its events fall into, published together with the
watermark before and after the batch. Spark's own watermark drops only events whose windows are all
closed and so counts late events into open windows; here events behind the watermark by more than the
lateness are kept out of them. The second query feeds what is published to Spark's state store
(``streaming.state``), whose timers follow the first one's watermark, and stores window results and their
corrections.

Spark moves a watermark once per micro-batch, not per event. ``Flow`` does the same: the watermark
a batch starts with decides which of its events are accepted and which windows they correct, and a
window gets at most one new version per batch.

A batch of the first query that is run again overwrites what its first attempt left; what it published stays,
since it is published by one rename and would be the same. The second query keeps its own place and
overwrites its results likewise.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import payload
from tidemark.functions.times import SECOND, Windows, micros, timestamp
from tidemark.operators import enrich, ingest
from tidemark.operators.windows import field_partials, packed, unpacked
from tidemark.plans.durable import exists, folders, make_folder, moved, remove
from tidemark.plans.sizing import dealt, measured_bytes
from tidemark.schemas import FACT_COLUMNS, WINDOW_RESULTS
from tidemark.sources.store import Store
from tidemark.streaming import state
from tidemark.streaming.progress import BatchReports

HEARTBEAT = "_heartbeat"
# Fixed value: error text of the dead-letter envelope for an event ahead of its arrival.
FUTURE = "Field 'event_time' lies in the future"

PROGRESS = T.StructType(
    [
        T.StructField("watermark_us", T.LongType()),
        T.StructField("last_arrival_us", T.LongType()),
        T.StructField("n_accepted", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
        T.StructField("n_dead", T.LongType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("now_us", T.LongType()),
        T.StructField("join_seconds", T.DoubleType()),
    ]
)


def heartbeats(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """Wall-clock rows to union with a raw stream, so that silence too produces batches."""
    beats = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return beats.select(
        F.lit(None).cast("string").alias("value"),
        F.lit(HEARTBEAT).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("value").alias("offset"),
        F.col("timestamp").alias("arrived_at"),
    )


class FlowRun:
    """A started flow: both of its queries, or the first with the second to follow when it has ended."""

    def __init__(self, queries: Sequence[StreamingQuery], after: Callable[[], None] | None = None):
        self.queries, self._after = list(queries), after

    def awaitTermination(self, timeout: float | None = None) -> bool | None:
        """Wait for the end; False when that did not come within ``timeout`` seconds."""
        for query in self.queries:
            if timeout is None:
                query.awaitTermination()
            elif not query.awaitTermination(timeout):
                return False
        if self._after is not None:
            self._after()
            self._after = None
        return True

    @property
    def isActive(self) -> bool:
        return any(query.isActive for query in self.queries)

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


@dataclass
class Flow:
    """Raw messages in; dead letters, enriched events, late events and window results out.

    ``dimension`` is called once per batch, so updates of the dimension reach the next batch; let it
    read a stored table. If it has a method ``version`` (as ``sources.dimension_table`` has), the table is
    measured again only when that changes. Pass ``attribute_types`` to spare each batch the search for them.

    ``fields`` are the numeric payload fields to aggregate, None all that are found, whenever they
    first appear. ``attribute_fields`` are numeric attributes of the dimension to aggregate as well, taken
    from the enriched event. The stored tables are laid out by the columns of the event envelope, so an
    attribute of such a name is stored with the suffix ``_right``.

    Events more than ``future_seconds`` ahead of their arrival are dead letters, so that none moves the
    watermark to a time that has not come; None accepts them. Late events correct a closed window for
    ``keep_seconds`` after the end of its block, always if None. Every ``upkeep_batches`` batches of results the
    stored results are folded and, with ``retention_days``, what is older than that before the watermark is deleted from
    all tables. ``name`` begins the names of the flow's
    queries; no two flows that run at once may share it.
    """

    spark: SparkSession
    root: str
    windows: Windows
    fields: Sequence[str] | None
    lateness_seconds: float = 10.0
    idle_timeout_seconds: float = 30.0
    dimension: Callable[[SparkSession], DataFrame] | None = None
    attribute_types: Mapping[str, str] | None = None
    attribute_fields: Sequence[str] = ()
    future_seconds: float | None = 300.0
    keep_seconds: float | None = None
    retention_days: float | None = None
    upkeep_batches: int = 64
    name: str = "flow"

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        self.store = Store(self.spark, self.root)
        self._measured: tuple[object, int] | None = None

    # -- running -------------------------------------------------------------------------------

    def start(self, raw: DataFrame, **trigger) -> FlowRun:
        """Without a trigger both queries take what is there and end, the second after the first."""
        trigger = trigger or {"availableNow": True}
        first = (
            raw.writeStream.foreachBatch(self.ingest)
            .queryName(f"{self.name}-ingest")
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**trigger)
            .start()
        )
        if trigger.get("availableNow") or trigger.get("once"):
            return FlowRun([first], self.settle)
        return FlowRun([first, self._windows_query(trigger)])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One batch from messages to window results."""
        self.ingest(batch, batch_id)
        self.settle()

    def settle(self) -> None:
        """Bring window results up to what has been published."""
        if exists(self.spark, f"{self.root}/published"):
            self._windows_query({"availableNow": True}).awaitTermination()

    def _windows_query(self, trigger: Mapping) -> StreamingQuery:
        make_folder(self.spark, f"{self.root}/published")
        state.set_state_store(self.spark)
        partials = (
            self.spark.readStream.schema(state.PARTIALS)
            .option("recursiveFileLookup", True)
            .option("cleanSource", "delete")
            .parquet(f"{self.root}/published")
        )
        return (
            state.window_changes(partials, self.windows, self.keep_seconds)
            .writeStream.foreachBatch(self.store_results)
            .queryName(f"{self.name}-windows")
            .option("checkpointLocation", f"{self.root}/checkpoint-windows")
            .trigger(**trigger)
            .start()
        )

    def reports(self) -> BatchReports:
        """Start to report on the batches of both queries, under the flow's folder."""
        listener = BatchReports(self.spark, f"{self.root}/reports", f"{self.name}-")
        self.spark.streams.addListener(listener)
        return listener

    # -- from messages to partials -------------------------------------------------------------

    def ingest(self, batch: DataFrame, batch_id: int) -> None:
        started = time.monotonic()
        lateness = round(self.lateness_seconds * SECOND)
        before, last_arrival = self._standing(batch_id)
        whole = self._decoded(dealt(batch, "topic", "partition", "offset")).persist()
        try:
            decoded = whole.filter(F.col("source_topic") != HEARTBEAT)
            facts = ingest.fact_events(decoded)
            on_time = F.lit(True) if before is None else (
                micros("event_time") >= F.lit(before - lateness)
            )
            good = F.col("error").isNull()
            seen = whole.agg(
                F.max(F.when(good, micros("event_time"))).alias("newest"),
                F.max(F.when(good, micros("ingest_time"))).alias("arrival"),
                F.count_if(good & on_time).alias("n_accepted"),
                F.count_if(good & ~on_time).alias("n_dropped"),
                F.count_if(~good & (F.col("source_topic") != HEARTBEAT)).alias("n_dead"),
                F.max(micros("ingest_time")).alias("now"),
            ).first()
            after = self._advanced(before, seen, last_arrival, lateness)
            # A batch is written only where it has rows; what its first attempt left is overwritten.
            self._write(ingest.dead_letters(decoded), "dead_letters", batch_id, seen.n_dead)
            joining = time.monotonic()
            if seen.n_accepted:
                self.store.add_events(self._enriched(facts.filter(on_time)), batch_id)
            joined = time.monotonic() - joining
            self._write(facts.filter(~on_time), "late_events", batch_id, seen.n_dropped)
            arrived = [t for t in (last_arrival, seen.arrival) if t is not None]
            row = (
                after,
                max(arrived, default=None),
                seen.n_accepted,
                seen.n_dropped,
                seen.n_dead,
                time.monotonic() - started,
                seen.now,
                joined,
            )
            self._write(_one_row(self.spark, row, PROGRESS), "progress", batch_id, 1)
            n_events = seen.n_accepted + seen.n_dropped
            if after is not None and (n_events or after != before):
                self._publish(facts if n_events else None, on_time, before, after, batch_id)
        finally:
            whole.unpersist()

    def _decoded(self, batch: DataFrame) -> DataFrame:
        decoded = ingest.decode(batch)
        if self.future_seconds is None:
            return decoded
        ahead = micros("event_time") > micros("ingest_time") + round(self.future_seconds * SECOND)
        return decoded.withColumn("error", F.coalesce("error", F.when(ahead, FUTURE)))

    def _advanced(self, before, seen, last_arrival, lateness) -> int | None:
        """The watermark after a batch: from its newest event, or from a silence."""
        candidates = [] if before is None else [before]
        if seen.newest is not None:
            candidates.append(seen.newest - lateness)
        elif seen.now is not None and last_arrival is not None:
            idle = round(self.idle_timeout_seconds * SECOND)
            if seen.now - last_arrival > idle:
                candidates.append(seen.now - idle)
        return max(candidates, default=None)

    def _enriched(self, facts: DataFrame) -> DataFrame:
        if self.dimension is None:
            return facts
        table = self.dimension(self.spark)
        return enrich.enrich(
            facts,
            table,
            self.attribute_types,
            on_conflict="override",
            store_table=False,
            protected=FACT_COLUMNS,
            table_bytes=self._table_bytes(table),
        )

    def _table_bytes(self, table: DataFrame) -> int | None:
        """Size of the dimension where its version tells that it is as last measured."""
        version = getattr(self.dimension, "version", None)
        if version is None:
            return None
        now = version(self.spark)
        if self._measured is None or self._measured[0] != now:
            self._measured = now, measured_bytes(table)
        return self._measured[1]

    def _write(self, rows: DataFrame, table: str, batch_id: int, count: int) -> None:
        path = f"{self.root}/{table}/batch_id={batch_id}"
        if count or exists(self.spark, path):
            rows.write.mode("overwrite").parquet(path)
        elif not exists(self.spark, f"{self.root}/{table}"):
            # So that the table can be read before it has rows.
            rows.limit(0).write.mode("overwrite").parquet(path)

    def _standing(self, batch_id: int) -> tuple[int | None, int | None]:
        """Watermark and last arrival at the end of the batch before."""
        path = f"{self.root}/progress/batch_id={batch_id - 1}"
        if batch_id == 0:
            return None, None
        if not exists(self.spark, path):
            raise RuntimeError(f"{path} is missing: without it the watermark would start anew")
        row = self.spark.read.schema(PROGRESS).parquet(path).first()
        return row.watermark_us, row.last_arrival_us

    def _publish(self, facts: DataFrame | None, on_time, before, after: int, batch_id: int) -> None:
        """The partials of a batch, all at once under a name that is its own."""
        target = f"{self.root}/published/batch_id={batch_id}"
        if exists(self.spark, target):
            return
        mark = timestamp(F.lit(after)).alias("mark")
        told = [F.lit(batch_id).cast("bigint").alias("batch"), F.lit(before).cast("bigint").alias("before"), mark]
        names = state.PARTIALS.fieldNames()[:7]
        rows = self.spark.range(1).select(
            *[F.lit(None).cast(state.PARTIALS[name].dataType).alias(name) for name in names], *told
        )
        if facts is not None:
            rows = self._partials(facts, on_time).select(*names, *told).unionByName(rows)
        path = f"{self.root}/publishing/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        make_folder(self.spark, f"{self.root}/published")
        moved(self.spark, path, target)

    def _partials(self, facts: DataFrame, on_time: Column) -> DataFrame:
        """One row per (pane, accepted or not, field) of the batch, in long form."""
        keys = ["pane", "accepted"]
        pane = self.windows.pane_of(micros("event_time")).alias("pane")
        listed = [*(self.fields or ()), *self.attribute_fields]
        if self.attribute_fields:
            facts = self._enriched(facts)
        own = [name for name in self.fields or () if name not in self.attribute_fields]
        numbers = facts.withColumn("_body", payload.body("payload_json")).select(
            pane,
            on_time.alias("accepted"),
            *[payload.number(F.col("_body"), name).alias(name) for name in own],
            *[F.col(name).try_cast("double").alias(name) for name in self.attribute_fields],
        )
        listed = [*own, *self.attribute_fields]
        wide = numbers.groupBy(*keys).agg(F.count("*").alias("_n"), *field_partials(listed))
        none = F.lit(None).cast("double")
        parts = [_partial(F.lit(state.COUNT), F.col("_n"), none, none, none)]
        parts += [
            _partial(F.lit(state.FIELD + name), *[F.col(f"_{name}_{x}") for x in ("n", "sum", "min", "max")])
            for name in listed
        ]
        rows = wide.select(*keys, F.inline(F.array(*parts))).filter("n > 0")
        if self.fields is not None:
            return rows
        found = payload.numeric_fields(facts.select(pane, on_time.alias("accepted"), "payload_json"), keys)
        return rows.unionByName(
            found.filter(~F.col("field").isin([*FACT_COLUMNS, *self.attribute_fields]))
            .groupBy(*keys, "field")
            .agg(*field_partials(["value"]))
            .select(
                *keys,
                _partial(
                    F.concat(F.lit(state.FIELD), "field"), *[F.col(f"_value_{x}") for x in ("n", "sum", "min", "max")]
                ).alias("_row"),
            )
            .select(*keys, "_row.*")
        )

    # -- window results ------------------------------------------------------------------------

    def store_results(self, changes: DataFrame, batch_id: int) -> None:
        """Changes of windows as rows of the stored table; fields that a correction leaves as they were are
        taken from the version before."""
        changes = changes.persist()
        try:
            head = F.col("field") == state.COUNT
            day = F.to_date(timestamp("start"))
            span = changes.filter(head).agg(
                F.min(F.when(F.col("step") < 0, F.col("start"))).alias("first"),
                F.collect_set(F.when(F.col("step") >= 0, day)).alias("days"),
                F.collect_set("step").alias("steps"),
            ).first()
            if not span.steps:
                return
            known = (
                self.store.window_writes(span.days)
                .filter(F.col("batch_id") < batch_id)
                .groupBy(micros("window_start").alias("start"))
                .agg(F.max_by("aggregations_json", F.struct("correction_version", "batch_id")).alias("known"))
                .select("start", F.map_entries(unpacked("known")).alias("known"))
            )
            rows = state.result_maps(changes).join(known, "start", "left")
            names = F.transform("entries", lambda x: x["key"])
            kept = F.filter("known", lambda x: ~F.array_contains(names, x["key"]))
            entries = F.concat(F.col("entries"), F.coalesce(kept, F.array().cast(rows.schema["entries"].dataType)))
            emitted = self._emitted(span.steps, span.first)
            self.store.add_windows(
                rows.select(
                    *self.windows.bounds("start"),
                    packed(F.map_from_entries(F.array_sort(entries))).alias("aggregations_json"),
                    F.col("event_count").cast("int").alias("event_count"),
                    (F.col("version") > 0).alias("is_correction"),
                    F.col("version").alias("correction_version"),
                    emitted.alias("emitted_at"),
                    emitted.alias("created_at"),
                ).select(*WINDOW_RESULTS.fieldNames()),
                batch_id,
            )
        finally:
            changes.unpersist()
        if batch_id % self.upkeep_batches == self.upkeep_batches - 1:
            self.upkeep()

    def upkeep(self) -> None:
        """Fold stored results and delete what is past its time; only the query that stores results may call it."""
        self.store.compact_windows()
        for path in folders(self.spark, f"{self.root}/published/batch_id=*"):
            # Partials that have been taken are deleted file by file; a batch's empty folder goes here.
            if not folders(self.spark, f"{path}/*.parquet") and self._settled(path):
                remove(self.spark, path)
        if self.retention_days is None:
            return
        progress = self.table("progress")
        newest = progress.agg(F.max("watermark_us")).first()[0]
        if newest is None:
            return
        cutoff = newest - round(self.retention_days * 86_400 * SECOND)
        self.store.drop_before(datetime.fromtimestamp(cutoff / SECOND, timezone.utc))
        # Batches as old as that: one number each, of those that have not been deleted yet.
        old = progress.filter(F.col("now_us") < cutoff).select("batch_id").collect()
        for row in old:
            for name in ("dead_letters", "late_events", "progress"):
                remove(self.spark, f"{self.root}/{name}/batch_id={row['batch_id']}")

    def _settled(self, path: str) -> bool:
        """Whether a later batch has been published: the newest one's folder tells that it was."""
        number = int(path.rpartition("=")[2])
        return exists(self.spark, f"{self.root}/progress/batch_id={number + 1}")

    def _emitted(self, steps: Sequence[int], first: int | None) -> Column:
        """Arrival of the batch that made a correction, or that closed a window.

        One small row per batch since the oldest of these windows ended reaches the driver.
        """
        wanted = F.col("batch_id").isin([step for step in steps if step >= 0])
        if first is not None:
            wanted = wanted | (F.col("watermark_us") >= first + self.windows.size)
        told = self.table("progress").filter(wanted).select("batch_id", "watermark_us", "now_us")
        marks = F.array(
            *[
                F.struct(*[F.lit(x).cast("bigint").alias(name) for x, name in zip(row, ("batch", "mark", "now"))])
                for row in sorted(told.collect())
            ]
        )
        own = F.filter(marks, lambda x: x["batch"] == F.col("step"))
        closing = F.filter(marks, lambda x: x["mark"] >= F.col("start") + self.windows.size)
        return timestamp(F.get(F.when(F.col("step") >= 0, own).otherwise(closing), F.lit(0))["now"])

    # -- reading -------------------------------------------------------------------------------

    def open_windows(self) -> DataFrame:
        """Results so far of the windows that the watermark has not closed, from the state store.

        The listed fields are columns; found ones come as the map ``aggregations``.
        """
        stored = (
            self.spark.read.format("statestore")
            .option("path", f"{self.root}/checkpoint-windows")
            .option("stateVarName", "panes")
            .load()
        )
        rows = state.result_maps(state.open_totals(stored, self.windows)).withColumn(
            "aggregations", F.map_from_entries("entries")
        )
        listed = [
            F.col("aggregations")[f"{name}_{part}"].alias(f"{name}_{part}")
            for name in (*(self.fields or ()), *self.attribute_fields)
            for part in ("sum", "min", "max", "avg")
        ]
        return rows.select(
            *self.windows.bounds("start"),
            F.col("version").alias("correction_version"),
            "event_count",
            *listed,
            *(["aggregations"] if self.fields is None else []),
        )

    def table(self, name: str) -> DataFrame:
        """A table the flow wrote: ``dead_letters``, ``late_events`` or ``progress``."""
        return self.spark.read.parquet(f"{self.root}/{name}")


def _partial(field: Column, n: Column, total: Column, low: Column, high: Column) -> Column:
    return F.struct(
        field.alias("field"), n.alias("n"), total.alias("total"), low.alias("low"), high.alias("high")
    )


def _one_row(spark: SparkSession, values: Sequence, schema: T.StructType) -> DataFrame:
    """A row made by Spark itself, without a Python worker."""
    return spark.range(1).select(
        *[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(values, schema.fields, strict=True)]
    )
