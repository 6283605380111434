"""Exact quantiles of large groups, by counting ranks over ordered ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import OrderedRows, Running


def exact_quantiles(
    rows: DataFrame,
    group: Sequence[str],
    value: str,
    tie: Sequence[str],
    continuous: Mapping[str, float] | None = None,
    discrete: Mapping[str, float] | None = None,
) -> DataFrame:
    """One row per group with the named quantiles of ``value``; nulls do not count.

    A continuous quantile lies between its two neighbours in proportion, a discrete one is the least
    value that the share reaches. Rows are cut into ranges of (group, value, tie), so a group or a
    value of any size spans as many tasks as it needs; ``tie`` must tell rows of one value apart.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*group, value, *tie)
    ranked = OrderedRows.of(known, [value, *tie], group).running(
        _rank=Running("count", F.lit(1), before=True)
    )
    sizes = known.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    placed = ranked.join(sizes, list(group))

    def at(rank):
        return F.max(F.when(F.col("_rank") == rank, F.col(value)))

    found, shown = [], []
    for name, share in (continuous or {}).items():
        place = F.lit(share) * (F.col("_size") - 1)
        found += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}")]
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        part = F.lit(share) * (F.col("_size") - 1) - F.floor(F.lit(share) * (F.col("_size") - 1))
        shown.append((low + (high - low) * part).alias(name))
    for name, share in (discrete or {}).items():
        place = F.greatest(F.ceil(F.lit(share) * F.col("_size")) - 1, F.lit(0))
        found.append(at(place).alias(name))
        shown.append(F.col(name))
    return placed.groupBy(*group, "_size").agg(*found).select(*group, *shown)
