"""Joins of whole texts with a table that names some of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import written
from tidemark.plans.sizing import BROADCAST_BYTES, measured_bytes


def join_stored(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str, label: str) -> DataFrame:
    """Join to a table that is stored and measured first.

    Up to ``BROADCAST_BYTES`` it is broadcast, and the rows stay where they are; a larger one, which only
    a large corpus brings, is joined by shuffle.
    """
    table = written(table, label)
    if measured_bytes(table) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    return rows.join(table, list(on), how)
