"""Decoding of raw messages into fact events, with the undecodable ones kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.functions.times import epoch_timestamp, iso_timestamp
from tidemark.schemas import DEAD_LETTER, FACT_COLUMNS

# Error texts of the dead-letter envelope.
NOT_JSON = "Malformed JSON message"
NOT_OBJECT = "Message is not a JSON object"
NO_KEY = "Missing or empty 'join_key' field"
BAD_KEY = "Field 'join_key' is not a scalar"
NO_TIME = "Missing 'event_time' field"
BAD_TIME = "Invalid 'event_time' field"


def event_time(value: Column, kind: Column | None = None) -> Column:
    """Timestamp of an ``event_time`` VARIANT: epoch seconds or ISO text, UTC by default."""
    if kind is None:
        kind = payload.kind(value)
    return F.when(
        kind == "STRING", iso_timestamp(F.try_variant_get(value, "$", "string"))
    ).when(
        payload.names_number(kind), epoch_timestamp(F.try_variant_get(value, "$", "decimal(38,9)"))
    )


def _error() -> Column:
    kind, text = F.col("_key_kind"), F.col("_key_text")
    zero = payload.names_number(kind) & (text.try_cast("double") == 0)
    empty = kind.isNull() | (kind == "VOID") | text.isin("", "[]", "{}") | zero
    return (
        F.when(F.col("_body").isNull(), NOT_JSON)
        .when(~payload.is_object_text("value"), NOT_OBJECT)
        .when(empty | ((kind == "BOOLEAN") & (text == "false")), NO_KEY)
        .when(kind.isin("OBJECT", "ARRAY"), BAD_KEY)
        .when(F.col("_time_kind").isNull() | (F.col("_time_kind") == "VOID"), NO_TIME)
        .when(F.col("event_time").isNull(), BAD_TIME)
    )


def decode(raw: DataFrame) -> DataFrame:
    """Raw messages with the fact event columns and ``error``, null for a good message.

    A message without ``event_id`` is named after its place in the topic, so a replay gives it
    the same id. The result passes through a one-element explode: a filter on ``error`` stays
    above it, where otherwise it would be pushed below and every message parsed twice.
    """
    place = F.concat_ws("-", "topic", "partition", "offset")
    key, time = F.col("_key"), F.col("_time")
    return (
        raw.withColumn("_body", payload.body("value"))
        .withColumns(
            {
                "_key": payload.field(F.col("_body"), "join_key"),
                "_time": payload.field(F.col("_body"), "event_time"),
                "_id": payload.field(F.col("_body"), "event_id", "string"),
            }
        )
        .withColumns(
            {
                "_key_kind": payload.kind(key),
                "_key_text": key.cast("string"),
                "_time_kind": payload.kind(time),
            }
        )
        .withColumn("event_time", event_time(time, F.col("_time_kind")))
        .withColumns(
            {
                "error": _error(),
                "event_id": F.coalesce("_id", place),
                "ingest_time": F.col("arrived_at"),
                "join_key": F.col("_key_text"),
                "payload_json": F.col("value"),
                "source_topic": F.col("topic"),
            }
        )
        .select(F.explode(F.array(F.struct("value", *FACT_COLUMNS, "error"))).alias("_decoded"))
        .select("_decoded.*")
    )


def fact_events(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNull()).select(*FACT_COLUMNS)


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Envelope of each undecodable message, stamped with its arrival."""
    return decoded.filter(F.col("error").isNotNull()).select(
        F.col("value").alias("original_message"),
        "error",
        F.col("ingest_time").alias("timestamp"),
        "source_topic",
        "partition",
        "offset",
    ).to(DEAD_LETTER)


def row_json(frame: DataFrame) -> DataFrame:
    """Each row as one JSON object of all its columns, nulls included."""
    return frame.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row_json")
    )
