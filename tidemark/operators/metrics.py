"""Operational measures of a run, computed from its tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import SECOND, floor_to, micros, timestamp
from tidemark.operators import watermark
from tidemark.operators.corrections import WindowReplay

# Upper bounds of the green and the amber band.
LAG_BANDS = (2.0, 5.0)
LATENCY_BANDS = (50.0, 200.0)


def throughput(events: DataFrame, every_seconds: int = 1, arrival: str = "ingest_time") -> DataFrame:
    """Events per second over each span of arrival time that saw any."""
    every = every_seconds * SECOND
    return (
        events.groupBy(floor_to(micros(arrival), every).alias("_span"))
        .agg(F.count("*").alias("n_events"))
        .select(
            timestamp("_span").alias("span_start"),
            "n_events",
            (F.col("n_events") / every_seconds).alias("events_per_second"),
        )
    )


def batch_rates(batches: DataFrame) -> DataFrame:
    """Rows per second of each join batch from its row count and elapsed time."""
    return batches.withColumn(
        "rows_per_second", F.when(F.col("elapsed_seconds") > 0, F.col("n_rows") / F.col("elapsed_seconds"))
    )


def p99(samples: DataFrame, value: str, order: Sequence[str], keep: int = 1000) -> DataFrame:
    """The value at rank floor(0.99 n) + 1 (at most n) of the newest ``keep`` samples."""
    newest = samples.orderBy(*[F.desc(c) for c in order]).limit(keep)
    # The sample list is capped by definition, so one sorted array of it is small.
    ranked = newest.agg(
        F.array_sort(F.collect_list(F.col(value))).alias("_values"), F.count(value).alias("n_samples")
    )
    rank = F.least(F.floor(F.col("n_samples") * 0.99) + 1, F.col("n_samples")).cast("int")
    return ranked.select(
        "n_samples",
        F.when(F.col("n_samples") > 0, F.get("_values", rank - 1)).otherwise(0.0).alias("p99"),
    )


def counters(run: WindowReplay) -> DataFrame:
    """One row: events processed and dropped, open windows, last lag and mean throughput."""
    replayed = watermark.with_lag(run.replayed)
    arrival = run.order[0]
    seconds = (F.max(micros(arrival)) - F.min(micros(arrival))) / SECOND
    return replayed.agg(
        F.count_if(F.col("decision") == watermark.ACCEPT).alias("events_processed"),
        F.count_if(F.col("decision") == watermark.DROP).alias("events_dropped"),
        F.try_divide(F.count("*"), seconds).alias("throughput"),
        F.max_by("lag_seconds", F.struct(*run.order)).alias("watermark_lag"),
    ).withColumn("active_windows", run.open().agg(F.count("*")).scalar())


def event_density(
    events: DataFrame,
    now: datetime,
    points: int = 60,
    every_seconds: int = 30,
    time: str = "event_time",
) -> DataFrame:
    """Event counts of the ``points`` spans that end at ``now``, empty spans included."""
    first = now - timedelta(seconds=points * every_seconds)
    every = every_seconds * SECOND
    origin = micros(F.lit(first))
    point = F.floor((micros(time) - origin) / every).cast("int")
    counts = (
        events.filter((F.col(time) >= F.lit(first)) & (F.col(time) < F.lit(now)))
        .groupBy(point.alias("point"))
        .agg(F.count("*").alias("n_events"))
    )
    spans = events.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    return (
        spans.join(counts, "point", "left")
        .select(
            "point",
            timestamp(origin + F.col("point") * every).alias("span_start"),
            F.coalesce("n_events", F.lit(0)).alias("n_events"),
        )
    )


def health_bands(measured: DataFrame, lag: str = "lag_seconds", latency: str = "latency_ms") -> DataFrame:
    """Rows per band of lag (seconds) and of latency (milliseconds)."""
    return (
        measured.select(
            F.explode(
                F.array(
                    F.struct(F.lit("lag").alias("measure"), _band(lag, LAG_BANDS).alias("band")),
                    F.struct(
                        F.lit("latency").alias("measure"), _band(latency, LATENCY_BANDS).alias("band")
                    ),
                )
            ).alias("_m")
        )
        .groupBy("_m.measure", "_m.band")
        .agg(F.count("*").alias("n_rows"))
    )


def _band(column: str, bounds: tuple[float, float]):
    return (
        F.when(F.col(column) < bounds[0], "green")
        .when(F.col(column) < bounds[1], "amber")
        .otherwise("red")
    )


def recent_series(
    events: DataFrame, every_seconds: int = 1, samples: int = 30, arrival: str = "ingest_time"
) -> DataFrame:
    """Throughput of every span (quiet ones too), scaled by the extremes of the last ``samples``.

    The scale runs from min(0, lowest) to max(1, highest). Spans are cut into stretches, and each
    stretch borrows the ``samples - 1`` spans before it, so no window task grows with the series.
    """
    every = every_seconds * SECOND
    stretch = max(3600, samples) * every
    reach = (samples - 1) * every
    counts = events.groupBy(floor_to(micros(arrival), every).alias("_span")).agg(
        F.count("*").alias("_n")
    )
    dense = (
        watermark.spine(counts, "_span", every)
        .unionByName(counts, allowMissingColumns=True)
        .groupBy("_span")
        .agg((F.coalesce(F.sum("_n"), F.lit(0)) / every_seconds).alias("events_per_second"))
    )
    home = floor_to(F.col("_span"), stretch)
    lent = floor_to(F.col("_span") + reach, stretch)
    shared = dense.withColumn("_home", home).withColumn(
        "_stretch", F.explode(F.array_distinct(F.array(home, lent)))
    )
    trailing = Window.partitionBy("_stretch").orderBy("_span").rowsBetween(-(samples - 1), 0)
    low = F.least(F.min("events_per_second").over(trailing), F.lit(0.0))
    high = F.greatest(F.max("events_per_second").over(trailing), F.lit(1.0))
    return (
        shared.withColumns({"low": low, "high": high})
        .filter(F.col("_stretch") == F.col("_home"))
        .select(
            timestamp("_span").alias("span_start"),
            "events_per_second",
            "low",
            "high",
            ((F.col("events_per_second") - F.col("low")) / (F.col("high") - F.col("low"))).alias(
                "scaled"
            ),
        )
    )
