"""Rules for events, dimension rows, windows and message bodies; profile of a topic's fields."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.functions.rules import Rules
from tidemark.plans.durable import written

# Names a message body must have, and the JSON type of each.
REQUIRED_FIELDS = {
    "event_id": "STRING",
    "event_time": "STRING",
    "join_key": "STRING",
    "payload": "OBJECT",
}
FUTURE_TOLERANCE = "INTERVAL 5 MINUTES"


def event_rules(now: datetime) -> Rules:
    return {
        "event_time_in_future": F.col("event_time") <= F.lit(now) + F.expr(FUTURE_TOLERANCE),
        "empty_join_key": F.length("join_key") > 0,
        "negative_partition": F.col("partition") >= 0,
        "negative_offset": F.col("offset") >= 0,
    }


def dimension_rules() -> Rules:
    return {
        "empty_dimension_key": F.length("dimension_key") > 0,
        "attributes_not_an_object": payload.kind(payload.body("attributes_json")) == "OBJECT",
        "version_below_one": F.col("version") >= 1,
    }


def window_rules() -> Rules:
    return {
        "start_not_before_end": F.col("window_start") < F.col("window_end"),
        "negative_event_count": F.col("event_count") >= 0,
        "negative_correction_count": F.col("correction_count") >= 0,
        "closed_without_emission": ~F.col("is_closed") | F.col("last_emitted_at").isNotNull(),
    }


def body_rules(body: Column) -> Rules:
    """Rules of the message schema: an object, required fields present and of their type."""
    is_object = F.coalesce(payload.kind(body) == "OBJECT", F.lit(False))
    rules = {"not_an_object": is_object}
    for name, json_type in REQUIRED_FIELDS.items():
        value = payload.field(body, name)
        rules[f"missing_{name}"] = ~is_object | value.isNotNull()
        rules[f"{name}_not_{json_type.lower()}"] = value.isNull() | (
            payload.kind(value) == json_type
        )
    rules["join_key_too_short"] = F.coalesce(
        (payload.kind(payload.field(body, "join_key")) != "STRING")
        | (F.length(payload.field(body, "join_key", "string")) >= 1),
        F.lit(True),
    )
    return rules


def conforms(body: Column) -> Column:
    ok = F.lit(True)
    for rule in body_rules(body).values():
        ok = ok & F.coalesce(rule, F.lit(False))
    return ok


def field_profile(messages: DataFrame, text: str = "value") -> DataFrame:
    """Per top-level field and JSON type: the messages that carry it and their share.

    Each message is parsed once: the first field of an object, or the row of an empty one, counts it.
    """
    fields = messages.sparkSession.tvf.variant_explode(F.col("_body").outer())
    found = (
        messages.filter(payload.is_object_text(text))
        .select(payload.body(text).alias("_body"))
        .filter(F.col("_body").isNotNull())
        .lateralJoin(fields.select("pos", "key", "value"))
        .groupBy(F.col("key").alias("field"), payload.kind(F.col("value")).alias("json_type"))
        .agg(
            F.count("*").alias("n_messages"),
            F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("_objects"),
        )
    )
    # Names may be free, so the rows stay apart; only their total is one number.
    found = written(found, "profile")
    objects = found.agg(F.sum("_objects")).scalar()
    return (
        found.withColumn("share", F.col("n_messages") / objects)
        .filter(F.col("field").isNotNull())
        .drop("_objects")
    )


def missing_fields(messages: DataFrame, expected: Sequence[str], text: str = "value") -> DataFrame:
    """Expected field names that not every message object carries, with the number lacking them.

    No row means the topic is compatible.
    """
    body = payload.body(text)
    present = messages.select(body.alias("_body")).filter(payload.kind(F.col("_body")) == "OBJECT")
    counts = present.agg(
        F.count("*").alias("n_messages"),
        *[
            F.count(payload.field(F.col("_body"), name)).alias(f"n{i}")
            for i, name in enumerate(expected)
        ],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("field"), (F.col("n_messages") - F.col(f"n{i}")).alias("n_lacking"))
            for i, name in enumerate(expected)
        ]
    )
    return (
        counts.select(F.explode(pairs).alias("pair"))
        .select("pair.*")
        .filter(F.col("n_lacking") > 0)
    )
