"""Exact replay of the event-time watermark over the arrival order.

watermark = max(event_time seen so far) - lateness, never falling. An event is accepted when it
is at most ``lateness`` behind the watermark after its own arrival, else dropped. With an idle
timeout, a silence longer than it lifts the watermark to (next arrival - idle timeout).

The order is total, so every running value here goes through ``OrderedRows``: no task ever holds
more than one range of the arrivals, however many events share a second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import SECOND, Windows, floor_to, micros, timestamp
from tidemark.plans.ordered import OrderedRows, Running
from tidemark.schemas import ARRIVAL_ORDER

ACCEPT = "accept"
DROP = "drop"
STRETCH = 4096


def replay(
    events: DataFrame,
    lateness_seconds: float = 10.0,
    idle_timeout_seconds: float | None = None,
    time: str = "event_time",
    order: Sequence[str] = ARRIVAL_ORDER,
) -> DataFrame:
    """Add ``watermark`` (after each event), ``decision`` and ``idle_watermark``.

    ``order`` must identify an event; its first column is the arrival time. ``idle_watermark`` is
    the instant a preceding silence lifted the watermark to, null without one.
    """
    lateness = round(lateness_seconds * SECOND)
    columns = events.columns
    rows = OrderedRows.of(
        events.withColumns({"_us": micros(time), "_arrived": micros(order[0])}), order
    )
    if idle_timeout_seconds is None:
        scanned = rows.running(_seen=Running("max", F.col("_us"))).withColumn(
            "_idle", F.lit(None).cast("bigint")
        )
        advanced = scanned.withColumn("_watermark", F.col("_seen") - lateness)
    else:
        idle = round(idle_timeout_seconds * SECOND)
        silent = F.col("_arrived") - F.col("_previous") > idle
        gaps = rows.running(
            _previous=Running("max", F.col("_arrived"), before=True),
            _seen=Running("max", F.col("_us")),
        ).withColumn("_idle", F.when(silent, F.col("_arrived") - idle))
        lifted = OrderedRows(gaps, order).running(_lifted=Running("max", F.col("_idle")))
        advanced = lifted.withColumn(
            "_watermark", F.greatest(F.col("_seen") - lateness, F.col("_lifted"))
        )
    return advanced.select(
        *columns,
        timestamp("_watermark").alias("watermark"),
        F.when(F.col("_us") >= F.col("_watermark") - lateness, ACCEPT)
        .otherwise(DROP)
        .alias("decision"),
        timestamp("_idle").alias("idle_watermark"),
    )


def decision_counts(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("decision").agg(F.count("*").alias("n_events"))


def dropped_count(replayed: DataFrame) -> DataFrame:
    return replayed.agg(F.count_if(F.col("decision") == DROP).alias("late_dropped_count"))


def with_lag(replayed: DataFrame, arrival: str = ARRIVAL_ORDER[0]) -> DataFrame:
    """Add ``lag_seconds``: arrival minus watermark, never below zero."""
    lag = (micros(arrival) - micros("watermark")) / SECOND
    return replayed.withColumn("lag_seconds", F.greatest(lag, F.lit(0.0)))


def ticks(
    replayed: DataFrame, every_seconds: int = 1, arrival: str = ARRIVAL_ORDER[0]
) -> DataFrame:
    """The watermark standing at the end of each tick, quiet ticks included.

    Columns: ``wall_clock`` (end of the tick), ``watermark``, ``lag_seconds``.
    """
    every = every_seconds * SECOND
    busy = replayed.groupBy(
        (floor_to(micros(arrival), every) + every).alias("_tick")
    ).agg(F.max(micros("watermark")).alias("_wm"))
    all_ticks = (
        spine(busy, "_tick", every)
        .unionByName(busy, allowMissingColumns=True)
        .groupBy("_tick")
        .agg(F.max("_wm").alias("_wm"))
    )
    carried = OrderedRows.of(all_ticks, ["_tick"]).running(_wm_now=Running("max", F.col("_wm")))
    return carried.select(
        timestamp("_tick").alias("wall_clock"),
        timestamp("_wm_now").alias("watermark"),
        F.greatest((F.col("_tick") - F.col("_wm_now")) / SECOND, F.lit(0.0)).alias("lag_seconds"),
    )


def spine(frame: DataFrame, column: str, every: int) -> DataFrame:
    """Every multiple of ``every`` between the column's extremes.

    Built in two steps so that no single task emits it: first one row per stretch of ticks, then,
    spread over the tasks, the ticks of each stretch.
    """
    stretch = STRETCH * every
    ends = frame.agg(F.min(column).alias("_first"), F.max(column).alias("_last"))
    stretches = ends.select(
        "_first",
        "_last",
        F.explode(
            F.sequence(floor_to(F.col("_first"), stretch), F.col("_last"), F.lit(stretch))
        ).alias("_from"),
    ).repartition("_from")
    tick = F.explode(
        F.sequence(F.col("_from"), F.col("_from") + stretch - every, F.lit(every))
    ).alias(column)
    return stretches.select("_first", "_last", tick).filter(
        F.col(column).between(F.col("_first"), F.col("_last"))
    ).select(column)


def closed_and_open(
    replayed: DataFrame, windows: Windows, time: str = "event_time"
) -> DataFrame:
    """Add ``n_closed`` and ``n_open``: the event's windows already closed on its arrival, or not.

    A window is closed once its end is at or below the watermark; both counts follow from the
    watermark by arithmetic, without listing the windows.
    """
    first = windows.first_start(micros(time))
    last = windows.last_start(micros(time))
    still_open = F.greatest(first, windows.first_open_start(micros("watermark")))
    total = ((last - first) / windows.slide + 1).cast("bigint")
    n_open = F.greatest(
        ((last - still_open) / windows.slide + 1).cast("bigint"), F.lit(0).cast("bigint")
    )
    return replayed.withColumn("n_open", n_open).withColumn("n_closed", total - F.col("n_open"))


def close_points(
    replayed: DataFrame,
    starts: DataFrame,
    windows: Windows,
    lateness_seconds: float = 10.0,
    time: str = "event_time",
    order: Sequence[str] = ARRIVAL_ORDER,
) -> DataFrame:
    """The arrival that closed each window of ``starts._start`` (epoch micros).

    An event closes every window whose end is at or below its own time less the lateness (or the
    idle lift before it). Events are reduced to the first one per largest window start they close;
    a window's closer is the minimum over all starts from its own upwards. Windows still open have
    no row.
    """
    lateness = round(lateness_seconds * SECOND)
    reach = F.greatest(micros(time) - lateness, micros("idle_watermark")) - windows.size
    closers = replayed.groupBy(floor_to(reach, windows.slide).alias("_start")).agg(
        F.min(F.struct(*order)).alias("_closer")
    )
    slots = (
        starts.select("_start", F.lit(True).alias("_wanted"))
        .unionByName(closers, allowMissingColumns=True)
        .groupBy("_start")
        .agg(F.min("_closer").alias("_closer"), F.max("_wanted").alias("_wanted"))
        .withColumn("_down", -F.col("_start"))
    )
    first = OrderedRows.of(slots, ["_down"]).running(_first=Running("min", F.col("_closer")))
    return first.filter("_wanted and _first is not null").select("_start", "_first.*")
