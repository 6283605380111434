"""Left joins of fact events with the dimension table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.operators import dimension
from tidemark.plans.durable import written
from tidemark.plans.ordered import OrderedRows, Running
from tidemark.plans.sizing import left_join
from tidemark.schemas import ARRIVAL_ORDER


def attribute_keys(table: DataFrame) -> DataFrame:
    """Sorted distinct attribute names; rows whose attributes are no JSON object are skipped."""
    return (
        table.select(F.explode(F.json_object_keys("attributes_json")).alias("attribute"))
        .distinct()
        .orderBy("attribute")
    )


def attribute_types(table: DataFrame) -> dict[str, str]:
    """Column type of each attribute, by name.

    One grouped aggregate over (name, value) pairs; only the (name, type) pairs that become columns
    reach the driver.
    """
    fields = table.sparkSession.tvf.variant_explode(F.col("_body").outer()).select("key", "value")
    found = (
        table.filter(payload.is_object_text("attributes_json"))
        .select(payload.body("attributes_json").alias("_body"))
        .lateralJoin(fields)
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.schema_of_variant_agg("value").alias("kind"))
    )
    return {row["key"]: _column_type(row["kind"]) for row in found.orderBy("key").collect()}


def _column_type(json_type: str | None) -> str:
    """Numbers and booleans keep their kind; text, nesting and mixtures become text."""
    if json_type in ("BIGINT", "BOOLEAN"):
        return json_type.lower()
    if json_type and json_type.startswith(("DECIMAL", "DOUBLE", "FLOAT")):
        return "double"
    return "string"


def flatten_attributes(
    table: DataFrame,
    types: Mapping[str, str] | None = None,
    keep: Sequence[str] = ("dimension_key",),
) -> DataFrame:
    """The ``keep`` columns and one column per attribute, null where a row lacks it."""
    if types is None:
        types = attribute_types(table)
    return table.withColumn("_body", payload.body("attributes_json")).select(
        *keep, *_attribute_columns(F.col("_body"), types)
    )


def _attribute_columns(body: Column, types: Mapping[str, str]) -> list[Column]:
    return [
        payload.field(body, name, as_type).alias(name) for name, as_type in types.items()
    ]


def enrich(
    facts: DataFrame,
    table: DataFrame,
    types: Mapping[str, str] | None = None,
    on_conflict: str = "suffix",
    spread: Sequence[str] = ARRIVAL_ORDER,
    store_table: bool = True,
    protected: Sequence[str] = (),
    table_bytes: int | None = None,
) -> DataFrame:
    """Facts left-joined with the flattened attributes of the active dimension rows.

    An attribute named like a fact column is added as ``<name>_right`` (``on_conflict="suffix"``)
    or replaces the fact value (``"override"``). Under ``"override"`` a matched row keeps its own
    value where its dimension row lacks the attribute, and an unmatched row gets null; an attribute that
    does not fit the fact column's type counts as null. Columns in ``protected`` are never replaced:
    attributes of their names get the suffix. ``table_bytes`` is the table's size where it is known.
    """
    if on_conflict not in ("suffix", "override"):
        raise ValueError("on_conflict must be 'suffix' or 'override'")
    current = dimension.active(table)
    if types is None:
        current = written(current, "dimension")
        types = attribute_types(current)
    if not types:
        return facts
    attributes = F.struct(*_attribute_columns(F.col("_body"), types)).alias("_attributes")
    names = F.json_object_keys("attributes_json").alias("_names")
    # One attribute struct per key keeps the join narrow; a null struct is a miss.
    flat = current.withColumn("_body", payload.body("attributes_json")).select(
        F.col("dimension_key").alias("join_key"), attributes, names
    )
    joined = left_join(
        facts, flat, ["join_key"], spread=spread, store_table=store_table, table_bytes=table_bytes
    )
    return joined.select(*_merged_columns(facts, types, on_conflict, protected))


def _merged_columns(
    facts: DataFrame, types: Mapping[str, str], on_conflict: str, protected: Sequence[str] = ()
) -> list[Column]:
    taken = set(facts.columns)
    kept = []
    for name in facts.columns:
        if name in types and on_conflict == "override" and name not in protected:
            own = F.when(
                F.col("_attributes").isNotNull() & ~F.array_contains("_names", name), F.col(name)
            ).otherwise(F.col("_attributes").getField(name).try_cast(facts.schema[name].dataType))
            kept.append(own.alias(name))
        else:
            kept.append(F.col(name))
    for name in types:
        if name not in taken:
            kept.append(F.col("_attributes").getField(name).alias(name))
        elif on_conflict == "suffix" or name in protected:
            kept.append(F.col("_attributes").getField(name).alias(f"{name}_right"))
    return kept


def enrich_as_of(
    facts: DataFrame,
    changes: DataFrame,
    change_order: Column,
    fact_order: Column,
) -> DataFrame:
    """Each fact with the dimension state current when it is processed.

    ``fact_order`` and ``change_order`` are comparable positions (arrival times or sequence
    numbers); a change at the same position is already visible. Adds ``attributes_json`` and
    ``version``, null when the key is unknown or deleted at that point. Facts and changes go
    through one range shuffle by (key, position): the state is a running maximum of the highest
    version and of the last delete, so stale versions never win and a hot key is split.
    """
    upsert = (F.col("op") == "upsert") & (F.col("version") > 0)
    rank = F.struct("version", (-F.col("seq")).alias("first"), "seq", "attributes_json")
    both = changes.select(
        F.col("dimension_key").alias("_key"),
        change_order.alias("_at"),
        F.lit(0).alias("_side"),
        F.col("seq").cast("string").alias("_tie"),
        F.when(upsert, rank).alias("_upsert"),
        F.when(F.col("op") == "delete", F.col("seq")).alias("_delete"),
    ).unionByName(
        facts.select(
            F.col("join_key").alias("_key"),
            fact_order.alias("_at"),
            F.lit(1).alias("_side"),
            F.concat_ws("|", *ARRIVAL_ORDER).alias("_tie"),
            F.struct("*").alias("_fact"),
        ),
        allowMissingColumns=True,
    )
    state = OrderedRows.of(both, ["_at", "_side", "_tie"], ["_key"]).running(
        _winner=Running("max", F.col("_upsert")), _deleted=Running("max", F.col("_delete"))
    )
    live = F.col("_winner").isNotNull() & F.coalesce(
        F.col("_deleted") < F.col("_winner.seq"), F.lit(True)
    )
    return state.filter(F.col("_side") == 1).select(
        "_fact.*",
        F.when(live, F.col("_winner.attributes_json")).alias("attributes_json"),
        F.when(live, F.col("_winner.version")).alias("version"),
    )
