"""Joins of two large tables on overlapping intervals.

An overlap is no equality, so Spark would compare each row with each. Here the line is cut into bins as wide as
an interval is on average; a row lies in every bin that its interval reaches, which makes two rows or
so of each, and rows meet in the bins they share. A pair that shares several is kept in the first of them, the
bin where the later interval starts. A bin with very many rows is a grid of tasks: its left rows are dealt
over the grid's rows and repeated over its columns, its right rows the other way round, so each pair meets in
one task and none gets more than its share of either side.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import written
from tidemark.plans.sizing import BROADCAST_BYTES, TARGET_ROWS, left_join, measured_bytes


@dataclass(frozen=True)
class Span:
    """A half-open interval of whole numbers, [start, end); rows with an empty one match nothing."""

    start: Column
    end: Column

    @classmethod
    def at(cls, point: Column) -> Span:
        return cls(point, point + 1)


def bin_width(left: DataFrame, right: DataFrame) -> int:
    """The larger of both sides' mean lengths: at that width a side of n rows lies in about 2 n bins at most."""
    means = [rows.agg(F.avg(F.col("_end") - F.col("_start"))).first()[0] for rows in (left, right)]
    return max(1, *(round(mean) for mean in means if mean is not None), 1)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_span: Span,
    right_span: Span,
    width: int | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Each pair of rows whose intervals overlap: the columns of ``left`` and those of ``right``.

    Column names of the two sides must differ. Bounds are longs; null bounds match nothing.
    """
    sides = []
    for rows, span, label in ((left, left_span, "left"), (right, right_span, "right")):
        placed = rows.withColumns({"_start": span.start.cast("bigint"), "_end": span.end.cast("bigint")})
        # Rows are dealt by a number that is stored, so that a task run again deals them the same.
        numbered = placed.filter(F.col("_start") < F.col("_end")).withColumn("_row", F.monotonically_increasing_id())
        sides.append(written(numbered, f"intervals-{label}"))
    if width is None:
        width = bin_width(*sides)
    left, right = (_binned(rows, width) for rows in sides)
    grid = _grid(left, right, target_rows)
    if measured_bytes(grid) <= BROADCAST_BYTES:
        grid = F.broadcast(grid)
    one = _dealt(left, grid, "_left", "_right").withColumnsRenamed({"_start": "_left_start", "_end": "_left_end"})
    two = _dealt(right, grid, "_right", "_left").withColumnsRenamed({"_start": "_right_start", "_end": "_right_end"})
    later = F.greatest("_left_start", "_right_start")
    overlap = (F.col("_left_start") < F.col("_right_end")) & (F.col("_right_start") < F.col("_left_end"))
    return (
        one.join(two, ["_bin", "_left", "_right"])
        .filter(overlap & (F.col("_bin") == _bin(later, width)))
        .drop("_bin", "_left", "_right", "_left_start", "_left_end", "_right_start", "_right_end")
    )


def covering_aggregates(
    points: DataFrame,
    intervals: DataFrame,
    at: Column,
    span: Span,
    partials: Mapping[str, Column],
    merged: Mapping[str, Column],
) -> DataFrame:
    """``points``, each with aggregates over the intervals that contain it; points in none are left out.

    Rows at one place have one answer, and rows of one interval one share in it. So intervals are reduced to
    ``partials`` by their bounds, places are joined with those, ``merged`` folds the partials of a place by their
    names, and the answer goes back to the points: pairs are of places and bounds, however many rows share them.
    """
    placed = written(points.withColumn("_at", at.cast("bigint")), "points")
    bounds = {"_from": span.start.cast("bigint"), "_to": span.end.cast("bigint")}
    reduced = intervals.groupBy(*[c.alias(name) for name, c in bounds.items()]).agg(
        *[c.alias(name) for name, c in partials.items()]
    )
    places = placed.select(F.col("_at").alias("_place")).distinct()
    found = (
        interval_join(places, reduced, Span.at(F.col("_place")), Span(F.col("_from"), F.col("_to")))
        .groupBy(F.col("_place").alias("_at"))
        .agg(*[c.alias(name) for name, c in merged.items()], F.lit(True).alias("_found"))
    )
    columns = [*points.columns, *merged]
    return left_join(placed, found, ["_at"], points.columns).filter("_found").select(*columns)


def _bin(at: Column, width: int) -> Column:
    return F.floor((at - F.pmod(at, F.lit(width))) / width).cast("bigint")


def _binned(rows: DataFrame, width: int) -> DataFrame:
    last = _bin(F.col("_end") - 1, width)
    return rows.withColumn("_bin", F.explode(F.sequence(_bin(F.col("_start"), width), last)))


def _grid(left: DataFrame, right: DataFrame, target_rows: int) -> DataFrame:
    """Bins that hold more than ``target_rows`` of a side, with the shape of their grids.

    There are no more of them than rows / target_rows.
    """
    counts = (
        left.select("_bin", F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select("_bin", F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .groupBy("_bin")
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        .filter((F.greatest("_l", "_r") > target_rows) & (F.least("_l", "_r") > 0))
    )
    shape = [F.ceil(F.col(c) / target_rows).cast("int").alias(n) for c, n in (("_l", "_lefts"), ("_r", "_rights"))]
    return written(counts.select("_bin", *shape), "interval-grid")


def _dealt(rows: DataFrame, grid: DataFrame, own: str, other: str) -> DataFrame:
    """Rows with their place in the grid of their bin: dealt along one side of it, repeated along the other."""
    dealt = F.pmod(F.xxhash64("_row"), F.coalesce(f"{own}s", F.lit(1)))
    return (
        rows.join(grid, "_bin", "left")
        .withColumn(own, dealt.cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}s", F.lit(1)) - 1)))
        .drop("_lefts", "_rights", "_row")
    )
