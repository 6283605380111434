"""Joins that pick their shape from measured sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.durable import written

BROADCAST_BYTES = 32 * 1024 * 1024
# Rows of one key that a task of a shuffle join is given, about.
TARGET_ROWS = 1_000_000


def measured_bytes(frame: DataFrame) -> int:
    """Uncompressed size of the rows, from one aggregate over ``frame``."""
    size = F.lit(0)
    for field in frame.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            size = size + F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0)) + 16
        else:
            size = size + 16
    return frame.agg(F.sum(size.cast("bigint"))).first()[0] or 0


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` over as many tasks as a shuffle has, by the hash of ``keys``.

    For work that costs far more than reading its rows: a file, row group or topic partition comes in one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def left_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    broadcast_bytes: int = BROADCAST_BYTES,
    store_table: bool = True,
    table_bytes: int | None = None,
) -> DataFrame:
    """Left join to a table with one row per key.

    The table is written once, so that measuring it and joining it do not compute it twice; turn
    ``store_table`` off for one that is cheap to read again, and pass ``table_bytes`` where its size is known. Below
    ``broadcast_bytes`` it is broadcast. A larger one is joined by shuffle, with the heavy keys of
    ``rows`` salted: their rows are dealt out by the ``spread`` columns (which must vary within a key) and
    their one table row is repeated per salt.
    """
    if store_table:
        table = written(table, "joined-table")
    if table_bytes is None:
        table_bytes = measured_bytes(table)
    if table_bytes <= broadcast_bytes:
        return rows.join(F.broadcast(table), list(on), "left")
    return salted_left_join(rows, table, on, spread)


def salted_left_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Left join by shuffle in which no key brings much more than ``target_rows`` rows to a task.

    Every key with more rows is dealt over as many salts as it holds targets, and its row of the table
    is repeated for each. Null keys match nothing; many of them are dealt out likewise.
    """
    on = list(on)
    # The count reads the key columns only. There are no more hot keys than rows / target_rows.
    hot = written(
        rows.groupBy(*on)
        .count()
        .filter(F.col("count") > target_rows)
        .select(*on, F.ceil(F.col("count") / target_rows).cast("int").alias("_salts")),
        "hot-keys",
    )
    if measured_bytes(hot) <= BROADCAST_BYTES:
        hot = F.broadcast(hot)
    names = {name: f"_hot_{name}" for name in on}
    same = F.lit(True)
    for name, other in names.items():
        same = same & F.col(name).eqNullSafe(F.col(other))
    salted_rows = (
        rows.join(hot.withColumnsRenamed(names), same, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_salts")))
            .otherwise(0)
            .cast("int"),
        )
        .drop("_salts", *names.values())
    )
    last = F.coalesce(F.col("_salts"), F.lit(1)) - 1
    salted_table = (
        table.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("_salts")
    )
    return salted_rows.join(salted_table, [*on, "_salt"], "left").drop("_salt")
