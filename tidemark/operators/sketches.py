"""Distinct counts that merge: sketches per pane, kept beside the other partials.

An exact distinct count needs every value again for each window that slides over it and for each late
event. A HyperLogLog sketch of a pane is a few kilobytes whatever the pane holds, sketches of the same
value twice are the same, and the union of two is the sketch of both. So windows are unions of their panes, and a
correction is the union of a window's sketch with those of its late events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import Windows, micros

# 2^12 registers: a standard error of about 1.6 %.
LG_REGISTERS = 12


def pane_sketches(
    events: DataFrame,
    windows: Windows,
    value: str,
    keys: Sequence[str] = (),
    time: str = "event_time",
    lg_registers: int = LG_REGISTERS,
) -> DataFrame:
    """One sketch of ``value`` per (keys, pane): ``_pane`` and ``sketch``. Null values count for nothing."""
    return (
        events.filter(F.col(value).isNotNull())
        .withColumn("_pane", windows.pane_of(micros(time)))
        .groupBy(*keys, "_pane")
        .agg(F.hll_sketch_agg(value, F.lit(lg_registers)).alias("sketch"))
    )


def window_sketches(
    panes: DataFrame, windows: Windows, keys: Sequence[str] = (), lg_registers: int = LG_REGISTERS
) -> DataFrame:
    """Pane sketches merged into one per (keys, window start): ``_start`` and ``sketch``.

    A window of very many panes is made by doubling: the sketch of 2 n panes is the union of two of n, and the
    window that of the two longest stretches that reach from its ends, which may overlap since the
    union of a pane with itself changes nothing. That is a handful of rows per pane, not one per window.
    """
    count = windows.size // windows.pane
    stretch, rows = 1, panes.select(*keys, F.col("_pane").alias("_at"), "sketch")
    if windows.wide:
        while 2 * stretch <= count:
            # A stretch that begins at a pane begins one of half its length before it too.
            rows = _merged(rows, stretch * windows.pane, keys)
            stretch *= 2
        # A window begins with a stretch and ends with one.
        back = (count - stretch) * windows.pane
        starts = F.array_distinct(F.array(F.col("_at"), F.col("_at") - back))
    else:
        starts = windows.starts(windows.first_start(F.col("_at")), windows.last_start(F.col("_at")))
    spread = rows.withColumn("_start", F.explode(starts))
    return (
        spread.filter(F.pmod("_start", F.lit(windows.slide)) == 0)
        .groupBy(*keys, "_start")
        .agg(F.hll_union_agg("sketch").alias("sketch"))
    )


def _merged(rows: DataFrame, length: int, keys: Sequence[str]) -> DataFrame:
    """Stretches of twice the length, by their beginning; one that begins in an empty half is there too."""
    begins = F.explode(F.array(F.col("_at"), F.col("_at") - length))
    return (
        rows.withColumn("_at", begins).groupBy(*keys, "_at").agg(F.hll_union_agg("sketch").alias("sketch"))
    )


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored sketches and those of late events, merged by their keys."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, name: str) -> DataFrame:
    """The sketches' counts in place of the sketches."""
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")
