"""Window results kept in Spark's state store.

The input are partials in long form, one row per (batch, pane, field) with the watermark the batch
started from and the one it left behind. Time is cut into blocks at least as long as a window. A
state belongs to one (block, field) and serves the windows that start in the block: partials of the
panes that windows still open may need, and the totals of those that are closed. So the count of
events and each field found in them live apart and no task gathers the fields of a window.

A window closes when the watermark reaches its end: a timer in event time emits version 0, its panes
go as soon as no open window needs them. A late partial goes to the totals of the closed windows that
contain it, and each gets a further version per batch. A batch costs what its partials touch,
however long the job has run; ``keep_seconds`` bounds how long closed windows wait for late events.

Results do not depend on how the batches fall into the micro-batches of this query: every partial says
which watermark it met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.times import SECOND, Windows, floor_to
from tidemark.operators.windows import SHARES

# The field under which all events are counted; others have FIELD before their name.
COUNT = ""
FIELD = "="

PARTIALS = T.StructType(
    [
        T.StructField("pane", T.LongType()),  # null in the row that only tells the watermark
        T.StructField("accepted", T.BooleanType()),
        T.StructField("field", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("batch", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("mark", T.TimestampType()),
    ]
)
# ``step`` is -1 for version 0 and the batch for a correction; ``version`` counts those of the field.
CHANGES = "start long, field string, step long, version int, n long, total double, low double, high double"
_PANE = np.dtype([("pane", "<i8"), ("n", "<i8"), ("total", "<f8"), ("low", "<f8"), ("high", "<f8")])
_CLOSED = np.dtype([("start", "<i8"), ("version", "<i8"), *[(x, _PANE[x]) for x in _PANE.names[1:]]])
_NEVER = np.iinfo(np.int64).min


# State with timers needs RocksDB; with a changelog a batch writes what it changes.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def set_state_store(spark: SparkSession) -> None:
    """Session settings that queries with such state are started under."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


# Windows that start in a block, at least: a batch that brings many hours at once then asks for few states.
BLOCK_WINDOWS = 64


def block_length(windows: Windows) -> int:
    return max(-(-windows.size // windows.slide), BLOCK_WINDOWS) * windows.slide


def blocks_of(pane: Column, windows: Windows) -> Column:
    """The blocks in which windows that contain a pane start: its own and the one before."""
    length = block_length(windows)
    own = floor_to(pane, length)
    reached = pane < own + windows.size - windows.slide
    return F.array_compact(F.array(own, F.when(reached, own - length)))


class _Panes:
    """Partials of the panes of a block, in order of time."""

    def __init__(self, blob: bytes | None):
        self.closed_upto = _NEVER if blob is None else int.from_bytes(blob[:8], "little", signed=True)
        self.rows = np.zeros(0, _PANE) if blob is None else np.frombuffer(blob[8:], _PANE)

    def blob(self) -> bytes:
        return self.closed_upto.to_bytes(8, "little", signed=True) + self.rows.tobytes()

    def add(self, more: np.ndarray) -> None:
        rows = np.concatenate((self.rows, more))
        panes, place = np.unique(rows["pane"], return_inverse=True)
        out = np.zeros(len(panes), _PANE)
        out["pane"], out["low"], out["high"] = panes, np.nan, np.nan
        for name, merge in (("n", np.add), ("total", np.add), ("low", np.fmin), ("high", np.fmax)):
            merge.at(out[name], place, rows[name])
        self.rows = out

    def total(self, first: int, end: int) -> np.ndarray:
        """(n, total, low, high) of the panes from one instant to another."""
        low, high = np.searchsorted(self.rows["pane"], (first, end))
        part = self.rows[low:high]
        if not len(part):
            return np.array([0, 0.0, np.nan, np.nan])
        return np.array([part["n"].sum(), part["total"].sum(), np.fmin.reduce(part["low"]), np.fmax.reduce(part["high"])])


class _Block:
    """The state of one (block, field) while its rows are worked on."""

    def __init__(self, windows: Windows, block: int, field: str, panes: bytes | None, closed: bytes | None):
        self.windows, self.field = windows, field
        self.first, self.last = block, block + block_length(windows) - windows.slide
        self.panes = _Panes(panes)
        rows = np.zeros(0, _CLOSED) if closed is None else np.frombuffer(closed, _CLOSED)
        self.closed = {int(row["start"]): list(row.item()[1:]) for row in rows}
        self.out: list[tuple] = []

    def closed_blob(self) -> bytes:
        rows = [(start, *rest) for start, rest in sorted(self.closed.items())]
        return np.array(rows, _CLOSED).tobytes()

    def starts(self, pane: int) -> range:
        """Starts in this block of the windows that contain a pane."""
        size, slide = self.windows.size, self.windows.slide
        first = max(self.first, (pane - size) // slide * slide + slide)
        return range(first, min(self.last, pane // slide * slide) + 1, slide)

    def close(self, watermark: int) -> None:
        """Version 0 of each window that the watermark has reached, if events were accepted in it."""
        size, slide = self.windows.size, self.windows.slide
        if watermark <= self.panes.closed_upto:
            return
        panes = self.panes.rows["pane"]
        if len(panes):
            first = max(self.starts(int(panes[0])).start, self.panes.closed_upto - size + 1)
            first = -(-first // slide) * slide
            last = min(self.starts(int(panes[-1])).stop - 1, watermark - size) // slide * slide
            for start in range(max(first, self.first), last + 1, slide):
                n, total, low, high = self.panes.total(start, start + size)
                if n:
                    self.closed[start] = [0, int(n), total, low, high]
                    self.emit(start, -1)
            # A pane is needed while the last window that contains it is open.
            reach = np.minimum(panes // slide * slide, self.last)
            self.panes.rows = self.panes.rows[reach + size > watermark]
        self.panes.closed_upto = watermark

    def emit(self, start: int, step: int) -> None:
        version, n, total, low, high = self.closed[start]
        self.out.append((start, self.field, step, version, n, total, low, high))

    def add(self, batch: int, before: int | None, accepted: np.ndarray, rows: np.ndarray) -> None:
        """The partials of one batch, which met the watermark ``before``."""
        if before is not None:
            self.close(before)
        upto, size = self.panes.closed_upto, self.windows.size
        touched = set()
        open_rows = np.zeros(len(rows), bool)
        for i, (pane, n, total, low, high) in enumerate(rows.tolist()):
            for start in self.starts(pane):
                if start + size > upto:
                    open_rows[i] = accepted[i]
                    break
                # What was never emitted is not corrected; a field may be new to a window.
                if start not in self.closed and self.field == COUNT:
                    continue
                known = self.closed.setdefault(start, [0, 0, 0.0, np.nan, np.nan])
                known[1:] = known[1] + n, known[2] + total, np.fmin(known[3], low), np.fmax(known[4], high)
                touched.add(start)
        for start in sorted(touched):
            self.closed[start][0] += 1
            self.emit(start, batch)
        if open_rows.any():
            self.panes.add(rows[open_rows])

    def next_end(self) -> int | None:
        """When the earliest open window with events ends."""
        if not len(self.panes.rows):
            return None
        size, slide = self.windows.size, self.windows.slide
        first = self.starts(int(self.panes.rows["pane"][0])).start
        if self.panes.closed_upto != _NEVER:
            first = max(first, (self.panes.closed_upto - size) // slide * slide + slide)
        return first + size


class WindowState(StatefulProcessor):
    """Keys (block, field); rows of ``PARTIALS`` in, rows of ``CHANGES`` out."""

    def __init__(self, windows: Windows, keep_seconds: float | None = None):
        self.windows, self.keep = windows, keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getValueState("panes", "blob binary")
        self.closed = handle.getValueState("closed", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block = self._loaded(key)
        frame = pd.concat(list(rows), ignore_index=True)
        for batch, own in frame.groupby("batch", sort=True):
            before = own["before"].iloc[0]
            values = np.zeros(len(own), _PANE)
            for name in _PANE.names:
                values[name] = own[name].to_numpy()
            met = None if pd.isna(before) else int(before)
            block.add(int(batch), met, own["accepted"].to_numpy(dtype=bool), values)
        yield self._stored(key, block)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        block = self._loaded(key)
        end = block.last + self.windows.size
        if self.keep is not None and watermark >= end + self.keep * SECOND:
            self.panes.clear()
            self.closed.clear()
            return
        block.close(watermark)
        yield self._stored(key, block)

    def close(self) -> None:
        pass

    def _loaded(self, key) -> _Block:
        blobs = [bytes(x.get()[0]) if x.exists() else None for x in (self.panes, self.closed)]
        return _Block(self.windows, int(key[0]), key[1], *blobs)

    def _stored(self, key, block: _Block) -> pd.DataFrame:
        self.panes.update((block.panes.blob(),))
        if block.out:
            self.closed.update((block.closed_blob(),))
        end = block.next_end()
        if end is not None:
            self.handle.registerTimer(-(-end // 1000))
        elif self.keep is not None:
            self.handle.registerTimer(-(-int(block.last + self.windows.size + self.keep * SECOND) // 1000))
        names = [x.split()[0] for x in CHANGES.split(", ")]
        return pd.DataFrame(block.out, columns=names)


def window_changes(partials: DataFrame, windows: Windows, keep_seconds: float | None = None) -> DataFrame:
    """A stream of ``PARTIALS`` as the changes of window results, one row per (window, field, step)."""
    # Rows that only tell the watermark go after it has been read from them: a condition that names the
    # marked column stays above that place. No mark lies before the first year.
    told = F.col("pane").isNotNull() | (F.col("mark") < F.lit("0001-01-01").cast("timestamp"))
    rows = (
        partials.withWatermark("mark", "0 seconds")
        .filter(told)
        .withColumn("block", F.explode(blocks_of(F.col("pane"), windows)))
        # Without the marked column no row is taken for late.
        .select("block", "field", "pane", "accepted", "n", "total", "low", "high", "batch", "before")
    )
    return rows.groupBy("block", "field").transformWithStateInPandas(
        statefulProcessor=WindowState(windows, keep_seconds),
        outputStructType=CHANGES,
        outputMode="Append",
        timeMode="EventTime",
    )


def open_totals(state: DataFrame, windows: Windows) -> DataFrame:
    """What the windows that are still open hold, from the stored panes (key.block, key.field, value.blob)."""

    def batches(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CHANGES.split(", ")]
        for frame in source:
            out = []
            for block, field, blob in zip(frame["block"], frame["field"], frame["blob"]):
                own = _Block(windows, int(block), field, bytes(blob), None)
                end = own.next_end()
                if end is None:
                    continue
                last = own.starts(int(own.panes.rows["pane"][-1])).stop - 1
                for start in range(end - windows.size, last // windows.slide * windows.slide + 1, windows.slide):
                    n, total, low, high = own.panes.total(start, start + windows.size)
                    if n:
                        out.append((start, field, -1, 0, int(n), total, low, high))
            yield pd.DataFrame(out, columns=names)

    flat = state.select("key.block", "key.field", "value.blob")
    return flat.mapInPandas(batches, CHANGES)


def result_maps(changes: DataFrame, salts: int = SHARES) -> DataFrame:
    """start, step, version, event_count and the map of aggregations of each window version.

    Entries of a version are those of its step and, for a field without one, of its last step before; what
    was stored before these changes is left to the caller. The entries of a window meet in two
    stages, first by shares of its fields.
    """
    heads = changes.filter(F.col("field") == COUNT).select("start", "step", "version", F.col("n").alias("event_count"))
    fields = changes.filter(F.col("field") != COUNT).withColumnRenamed("step", "at")
    name = F.expr(f"substring(field, {len(FIELD) + 1})")
    value = F.max_by(F.struct("n", "total", "low", "high"), "at").alias("value")
    parts = {
        "avg": F.try_divide("value.total", F.col("value.n").cast("double")),
        "max": F.nanvl("value.high", F.lit(None).cast("double")),
        "min": F.nanvl("value.low", F.lit(None).cast("double")),
        "sum": F.col("value.total"),
    }
    entries = F.array_compact(
        F.array(
            *[
                F.when(x.isNotNull(), F.struct(F.concat_ws("_", "name", F.lit(part)).alias("key"), x.alias("value")))
                for part, x in parts.items()
            ]
        )
    )
    gathered = (
        heads.select("start", "step")
        .join(fields, "start")
        .filter("at <= step")
        .withColumn("name", name)
        .groupBy("start", "step", "name")
        .agg(value)
        .select("start", "step", F.pmod(F.xxhash64("name"), F.lit(salts)).alias("salt"), entries.alias("entries"))
        .groupBy("start", "step", "salt")
        .agg(F.flatten(F.collect_list("entries")).alias("entries"))
        .groupBy("start", "step")
        .agg(F.flatten(F.collect_list("entries")).alias("entries"))
    )
    none = F.array().cast("array<struct<key: string, value: double>>")
    count = F.struct(F.lit("count").alias("key"), F.col("event_count").cast("double").alias("value"))
    return heads.join(gathered, ["start", "step"], "left").withColumn(
        "entries", F.concat(F.array(count), F.coalesce("entries", none))
    )


