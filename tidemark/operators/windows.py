"""Tumbling and sliding window aggregates.

Aggregates are decomposable, so events are first reduced to panes (slices no window boundary
cuts) and only the panes reach the windows that contain them. Panes of a few windows are repeated
for each; panes of many (a 300 s window sliding by 1 s) are merged by blocks instead, at two rows
per window. All steps combine map-side, so a pane that holds a third of the events is reduced
before it is shuffled.

A partial of a field is (sum, min, max, n); averages are divided at the end. NaN never becomes a
minimum or maximum, but does carry into sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import Windows, floor_to, micros

INFINITY = float("inf")
# Shares in which the fields of a window are first gathered.
SHARES = 16


def assign(events: DataFrame, windows: Windows, time: str = "event_time") -> DataFrame:
    """One row per (event, window that contains it), with ``window_id`` and bounds."""
    return (
        events.withColumn("_us", micros(time))
        .withColumn(
            "_start",
            F.explode(
                windows.starts(windows.first_start(F.col("_us")), windows.last_start(F.col("_us")))
            ),
        )
        .select(*events.columns, *windows.bounds("_start"))
    )


def field_partials(fields: Sequence[str]) -> list[Column]:
    out = []
    for name in fields:
        value = F.col(name).cast("double")
        out += [
            F.sum(value).alias(f"_{name}_sum"),
            F.min(F.when(value < F.lit(INFINITY), value)).alias(f"_{name}_min"),
            F.max(F.when(~F.isnan(value) & (value > F.lit(-INFINITY)), value)).alias(f"_{name}_max"),
            F.count(value).alias(f"_{name}_n"),
        ]
    return out


def merged_partials(fields: Sequence[str]) -> list[Column]:
    out = [F.sum("_n").alias("_n")]
    for name in fields:
        out += [
            F.sum(f"_{name}_sum").alias(f"_{name}_sum"),
            F.min(f"_{name}_min").alias(f"_{name}_min"),
            F.max(f"_{name}_max").alias(f"_{name}_max"),
            F.sum(f"_{name}_n").alias(f"_{name}_n"),
        ]
    return out


def finished(fields: Sequence[str]) -> list[Column]:
    """``event_count`` and, per field, sum, min, max and avg columns from merged partials."""
    out = [F.col("_n").cast("bigint").alias("event_count")]
    for name in fields:
        out += [
            F.col(f"_{name}_sum").alias(f"{name}_sum"),
            F.col(f"_{name}_min").alias(f"{name}_min"),
            F.col(f"_{name}_max").alias(f"{name}_max"),
            F.try_divide(f"_{name}_sum", f"_{name}_n").alias(f"{name}_avg"),
        ]
    return out


def pane_partials(
    events: DataFrame,
    windows: Windows,
    fields: Sequence[str],
    keys: Sequence[str] = (),
    time: str = "event_time",
) -> DataFrame:
    """Events reduced to one partial per (keys, pane)."""
    return (
        events.withColumn("_pane", windows.pane_of(micros(time)))
        .groupBy(*keys, "_pane")
        .agg(F.count("*").alias("_n"), *field_partials(fields))
    )


def window_partials(
    panes: DataFrame,
    windows: Windows,
    fields: Sequence[str],
    keys: Sequence[str] = (),
    first: Column | None = None,
) -> DataFrame:
    """Pane partials merged into one partial per (keys, window start).

    ``first`` limits a pane to windows that start at or after it; none may be after the last.
    """
    earliest = windows.first_start(F.col("_pane"))
    if not windows.wide:
        rows = _spread(panes, windows, earliest if first is None else first)
    elif first is None:
        rows = _block_sums(panes, windows, fields, keys)
    else:
        rows = _block_sums(panes.filter(first <= earliest), windows, fields, keys).unionByName(
            _spread(panes.filter(first > earliest), windows, first), allowMissingColumns=True
        )
    return rows.groupBy(*keys, "_start").agg(*merged_partials(fields))


def _spread(panes: DataFrame, windows: Windows, first: Column) -> DataFrame:
    """One row per (pane, window that contains it)."""
    last = windows.last_start(F.col("_pane"))
    return panes.withColumn("_start", F.explode(windows.starts(first, last)))


def _block_sums(
    panes: DataFrame, windows: Windows, fields: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """At most two rows per (keys, window start), however many panes a window has.

    Time is cut into blocks as long as a window. A window is the end of one block and the
    beginning of the next, so two running aggregates per block, one from each side, give every
    window. Blocks have a fixed number of panes, so no window task grows with the data.
    """
    merged = merged_partials(fields)
    names = ["_n", *(f"_{f}_{part}" for f in fields for part in ("sum", "min", "max", "n"))]
    block = floor_to(F.col("_pane"), windows.size)
    slots = (
        panes.select(*keys, block.alias("_block"))
        .distinct()
        .select(
            *keys,
            F.explode(
                F.sequence(
                    F.col("_block"), F.col("_block") + windows.size - windows.slide, F.lit(windows.slide)
                )
            ).alias("_pane"),
        )
    )
    dense = (
        panes.select(*keys, "_pane", *names)
        .unionByName(slots, allowMissingColumns=True)
        .groupBy(*keys, "_pane")
        .agg(*merged)
        .withColumn("_block", block)
    )
    sides = {}
    for side, order in (("head", F.col("_pane")), ("tail", F.col("_pane").desc())):
        frame = (
            Window.partitionBy(*keys, "_block")
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        for name in names:
            merge = F.min if name.endswith("_min") else F.max if name.endswith("_max") else F.sum
            sides[f"_{side}{name}"] = merge(name).over(frame)

    def part(side: str, start: Column) -> Column:
        return F.struct(
            start.alias("_start"), *[F.col(f"_{side}{name}").alias(name) for name in names]
        )

    whole = F.col("_pane") == F.col("_block") + windows.size - windows.slide
    ends = F.array_compact(
        F.array(
            part("tail", F.col("_pane")),
            F.when(~whole, part("head", F.col("_pane") + windows.slide - windows.size)),
        )
    )
    return (
        dense.withColumns(sides)
        .select(*keys, F.explode(ends).alias("_part"))
        .select(*keys, "_part.*")
        .filter("_n > 0")
    )


def aggregate(
    events: DataFrame,
    windows: Windows,
    fields: Sequence[str],
    keys: Sequence[str] = (),
    time: str = "event_time",
) -> DataFrame:
    """Count and per-field sum, min, max and avg of every non-empty window (per ``keys``)."""
    partials = pane_partials(events, windows, fields, keys, time)
    if windows.size == windows.slide:
        merged = partials.withColumnRenamed("_pane", "_start")
    else:
        merged = window_partials(partials, windows, fields, keys)
    return merged.select(*keys, *windows.bounds("_start"), *finished(fields))


def aggregate_fields(
    events: DataFrame,
    values: DataFrame,
    windows: Windows,
    time: str = "event_time",
) -> DataFrame:
    """Aggregations of every field found in the data, as one map per window.

    ``values`` holds (``time``, ``field``, ``value``) rows. The window's count covers all
    ``events``, those without any numeric field too. The entries of a window's map meet in two stages,
    first by shares of its fields, so that very many names are not gathered row by row in one task.
    """
    per_field = aggregate(values, windows, ["value"], ["field"], time)
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"value_{part}").isNotNull(),
                    F.struct(
                        F.concat_ws("_", "field", F.lit(part)).alias("key"),
                        F.col(f"value_{part}").alias("value"),
                    ),
                )
                for part in ("sum", "min", "max", "avg")
            ]
        )
    )
    fields = (
        per_field.withColumn("_share", F.pmod(F.xxhash64("field"), F.lit(SHARES)))
        .groupBy("window_id", "_share")
        .agg(F.flatten(F.collect_list(entries)).alias("_entries"))
        .groupBy("window_id")
        .agg(F.flatten(F.collect_list("_entries")).alias("_entries"))
    )
    counts = aggregate(events, windows, [], time=time)
    none = F.array().cast("array<struct<key: string, value: double>>")
    count = F.struct(F.lit("count").alias("key"), F.col("event_count").cast("double").alias("value"))
    return (
        counts.join(fields, "window_id", "left")
        .withColumn(
            "aggregations",
            F.map_from_entries(
                F.array_sort(F.concat(F.array(count), F.coalesce(F.col("_entries"), none)))
            ),
        )
        .drop("_entries")
    )


def aggregations(fields: Sequence[str]) -> Column:
    """The aggregation map of a wide result row: ``count`` and ``<field>_sum/_min/_max/_avg``."""
    names = ["count"] + [f"{f}_{part}" for f in fields for part in ("sum", "min", "max", "avg")]
    entries = [
        F.when(
            F.col(source).isNotNull(),
            F.struct(F.lit(name).alias("key"), F.col(source).cast("double").alias("value")),
        )
        for name, source in sorted((n, "event_count" if n == "count" else n) for n in names)
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def packed(aggregations_map: Column | str) -> Column:
    return F.to_json(aggregations_map)


def unpacked(aggregations_json: Column | str) -> Column:
    """Map of a packed text; an empty map when it is no JSON object."""
    empty = F.expr("cast(map() as map<string, double>)")
    return F.coalesce(F.from_json(aggregations_json, "map<string, double>"), empty)
