"""The versioned dimension table, kept as the fold of its change log.

A change applies when its version exceeds every earlier version of the key; a delete switches
the key off but keeps its version floor, so a later re-insert needs a higher version. Folding a
log in one pass: the winner is the highest version (the first to bring it), and the key is active
unless a delete came after the winner. Both are plain aggregates with map-side partials, so a key
that holds a third of the log costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.sizing import left_join
from tidemark.schemas import DIMENSION


def load_changes(records: DataFrame, key: str, seq: Column, updated_at: Column) -> DataFrame:
    """Bulk load records as changes: every column but ``key`` becomes an attribute.

    Rows without a key are skipped; a version that is missing, not an integer or below 1 counts
    as 1.
    """
    attributes = F.struct(*[name for name in records.columns if name != key])
    whole = "version" in records.columns and isinstance(
        records.schema["version"].dataType, T.IntegralType
    )
    version = F.col("version") if whole else F.lit(None).cast("bigint")
    return (
        records.withColumn("dimension_key", F.col(key).cast("string"))
        .filter(F.length("dimension_key") > 0)
        .select(
            "dimension_key",
            F.lit("upsert").alias("op"),
            F.to_json(attributes, {"ignoreNullFields": "false"}).alias("attributes_json"),
            F.when(version >= 1, version).otherwise(F.lit(1)).cast("bigint").alias("version"),
            seq.cast("bigint").alias("seq"),
            updated_at.alias("updated_at"),
        )
    )


def loaded(changes: DataFrame) -> DataFrame:
    """The table right after a bulk load, one row per key: highest version, then the last record."""
    return (
        changes.groupBy("dimension_key")
        .agg(
            F.max_by(
                F.struct("attributes_json", "version", "updated_at"), F.struct("version", "seq")
            ).alias("_row")
        )
        .select("dimension_key", "_row.*", F.lit(True).alias("is_active"))
    )


def replay(changes: DataFrame) -> DataFrame:
    """Fold a change log into the table it leaves behind."""
    upsert = (F.col("op") == "upsert") & (F.col("version") > 0)
    rank = F.when(upsert, F.struct(F.col("version"), (-F.col("seq")).alias("first")))
    return (
        changes.groupBy("dimension_key")
        .agg(
            F.max_by(
                F.struct("attributes_json", "version", "updated_at", "seq"), rank
            ).alias("_row"),
            F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("_deleted"),
        )
        .filter(F.col("_row").isNotNull())
        .select(
            "dimension_key",
            "_row.attributes_json",
            "_row.version",
            "_row.updated_at",
            F.coalesce(F.col("_deleted") < F.col("_row.seq"), F.lit(True)).alias("is_active"),
        )
    )


# What is left of a key's changes: its winning upsert, if it has one, and the place of its last delete.
STATE = T.StructType(
    [
        T.StructField("dimension_key", T.StringType()),
        T.StructField("attributes_json", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("deleted", T.LongType()),
    ]
)


def as_states(changes: DataFrame) -> DataFrame:
    """Each change as the state it would leave alone."""
    wins = (F.col("op") == "upsert") & (F.col("version") > 0)
    kept = [F.when(wins, F.col(name)).alias(name) for name in STATE.fieldNames()[1:5]]
    return changes.select("dimension_key", *kept, F.when(F.col("op") == "delete", F.col("seq")).alias("deleted"))


def fold_states(states: DataFrame) -> DataFrame:
    """One state per key. Folding in any order and in any parts gives what ``replay`` gives of all changes."""
    rank = F.when(F.col("version").isNotNull(), F.struct(F.col("version"), (-F.col("seq")).alias("first")))
    return (
        states.groupBy("dimension_key")
        .agg(
            F.max_by(F.struct("attributes_json", "version", "updated_at", "seq"), rank).alias("_row"),
            F.max("deleted").alias("deleted"),
        )
        .select("dimension_key", *[F.col(f"_row.{name}").alias(name) for name in STATE.fieldNames()[1:5]], "deleted")
    )


def from_states(states: DataFrame) -> DataFrame:
    """The table that the states stand for."""
    return states.filter(F.col("version").isNotNull()).select(
        "dimension_key",
        "attributes_json",
        "version",
        "updated_at",
        F.coalesce(F.col("deleted") < F.col("seq"), F.lit(True)).alias("is_active"),
    )


def as_changes(table: DataFrame) -> DataFrame:
    """A stored table as the start of a change log; an inactive row is a load and its delete."""
    rows = table.select(
        "dimension_key",
        F.explode(
            F.when(F.col("is_active"), F.array(F.lit("upsert"))).otherwise(
                F.array(F.lit("upsert"), F.lit("delete"))
            )
        ).alias("op"),
        "attributes_json",
        "version",
        "updated_at",
    )
    # Below every sequence number of the updates that follow.
    seq = F.lit(-(1 << 62)) + F.when(F.col("op") == "delete", 1).otherwise(0)
    return rows.withColumn("seq", seq.cast("bigint"))


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply upserts and deletes to a stored table."""
    return replay(as_changes(table).unionByName(changes.select(*as_changes(table).columns)))


def soft_delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Switch off the rows whose key is in ``keys.dimension_key``; unknown keys change nothing."""
    gone = keys.select("dimension_key").distinct().withColumn("_gone", F.lit(True))
    return (
        table.join(gone, "dimension_key", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_gone").isNull())
        .drop("_gone")
    )


def active(table: DataFrame) -> DataFrame:
    return table.filter("is_active")


def active_count(table: DataFrame) -> DataFrame:
    return active(table).agg(F.count_distinct("dimension_key").alias("row_count"))


def lookup(keys: DataFrame, table: DataFrame) -> DataFrame:
    """Attributes for each row of ``keys.dimension_key``, null when missing or inactive."""
    found = active(table).select("dimension_key", "attributes_json")
    return left_join(keys, found, ["dimension_key"], spread=keys.columns)


def rebuild(stored: DataFrame) -> DataFrame:
    """The table recovered from its stored rows: same keys and states, version floors kept."""
    return replay(as_changes(stored)).select(*DIMENSION.fieldNames())
