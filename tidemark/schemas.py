"""Column layouts of the messages, tables and results."""

from __future__ import annotations

from pyspark.sql import types as T

# Undecoded messages as a broker or a landing folder hands them over.
RAW_MESSAGE = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("arrived_at", T.TimestampType()),
    ]
)

FACT_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType(), False),
        T.StructField("event_time", T.TimestampType(), False),
        T.StructField("ingest_time", T.TimestampType(), False),
        T.StructField("join_key", T.StringType(), False),
        T.StructField("payload_json", T.StringType(), False),
        T.StructField("source_topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
    ]
)
FACT_COLUMNS = FACT_EVENT.fieldNames()

# A message's place in its topic: unique per record, and the order records are processed in.
ARRIVAL_ORDER = ("ingest_time", "partition", "offset")

DEAD_LETTER = T.StructType(
    [
        T.StructField("original_message", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source_topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)

DIMENSION = T.StructType(
    [
        T.StructField("dimension_key", T.StringType(), False),
        T.StructField("attributes_json", T.StringType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("updated_at", T.TimestampType(), True),
        T.StructField("is_active", T.BooleanType(), False),
    ]
)

# One change of the dimension: op is 'upsert' or 'delete'; seq orders the changes of a key.
DIMENSION_CHANGE = T.StructType(
    [
        T.StructField("dimension_key", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("attributes_json", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

JOINED_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("ingest_time", T.TimestampType()),
        T.StructField("join_key", T.StringType()),
        T.StructField("payload_json", T.StringType()),
        T.StructField("dimension_attrs_json", T.StringType()),
        T.StructField("source_topic", T.StringType()),
        T.StructField("partition_id", T.IntegerType()),
        T.StructField("offset_id", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

WINDOW_RESULTS = T.StructType(
    [
        T.StructField("window_id", T.StringType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("aggregations_json", T.StringType()),
        T.StructField("event_count", T.IntegerType()),
        T.StructField("is_correction", T.BooleanType()),
        T.StructField("correction_version", T.IntegerType()),
        T.StructField("emitted_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
