"""Connected components by alternating stars, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import written


def _stored(edges: DataFrame) -> DataFrame:
    """Written in two files for each core at most: the rounds are many and may be small."""
    cores = edges.sparkSession.sparkContext.defaultParallelism
    return written(edges.coalesce(2 * cores), "edges")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); component is the smallest id reachable.

    Each round hooks the neighbours of an id to the smallest of them, first those above the id, then
    those below, and stores the edges; a logarithmic number of rounds leaves stars. No adjacency
    list is gathered: the smallest neighbour is an aggregate with partial sums, and a hot id's edges
    meet it in a join whose partitions Spark may split. Null ids and loops are left out.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = _stored(edges.distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        lowest = lowest.select("a", F.least("a", "low").alias("low"))
        large = (
            both.join(lowest, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        large = _stored(large.distinct())
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(lowest, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .filter("a <> b")
            .unionByName(lowest.select("a", F.col("low").alias("b")))
        )
        edges = _stored(small.distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    tops = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops)
