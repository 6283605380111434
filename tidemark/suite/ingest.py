"""Queries on decoding, validation and fields of raw messages."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.functions.rules import checked, violation_counts
from tidemark.operators import ingest, validation
from tidemark.suite import data
from tidemark.suite.data import EV, TOPIC
from tidemark.suite.registry import query, snap, snap_sql

NOW = datetime(2024, 1, 25, tzinfo=timezone.utc)


def raw_messages(spark, sf_dir: str) -> DataFrame:
    """Supplied events as JSON texts; event_id % 50 selects a damage or a variant of the form."""
    e = data.events(spark, sf_dir)
    kind = F.col("event_id") % 50
    event_id = F.concat(F.lit('"event_id":"'), F.col("event_id").cast("string"), F.lit('",'))
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    epoch_us = F.unix_micros("event_time")
    epoch = F.concat(
        F.expr("unix_micros(event_time) div 1000000").cast("string"),
        F.lit("."),
        F.lpad(F.pmod(epoch_us, F.lit(1_000_000)).cast("string"), 6, "0"),
    )
    two_hours_on = F.date_format(
        F.col("event_time") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    )
    compact = F.date_format("event_time", "yyyyMMdd'T'HHmmss.SSSSSS")
    quoted = lambda text: F.concat(F.lit('"event_time":"'), text, F.lit('",'))
    time = (
        F.when(kind == 17, "")
        .when(kind == 19, '"event_time":"not-a-time",')
        .when(kind == 41, '"event_time":true,')
        .when(kind == 1, F.concat(F.lit('"event_time":1e'), (F.lit(20) + F.col("event_id") % 300).cast("string"), F.lit(",")))
        .when(kind == 3, F.concat(F.lit('"event_time":'), F.rpad((F.col("event_id") + 1).cast("string"), 29, "0"), F.lit(",")))
        .when(kind == 2, quoted(F.replace(iso, F.lit("T"), F.lit(" "))))
        .when(kind == 4, quoted(iso))
        .when(kind == 6, quoted(F.concat(two_hours_on, F.lit("+02:00"))))
        .when(kind == 8, quoted(compact))
        .when(kind % 2 == 0, quoted(F.concat(iso, F.lit("Z"))))
        .otherwise(F.concat(F.lit('"event_time":'), epoch, F.lit(",")))
    )
    user = F.col("user_id").cast("string")
    key = (
        F.when(kind == 11, "")
        .when(kind == 13, '"join_key":"",')
        .when(kind == 29, '"join_key":0,')
        .when(kind == 43, F.concat(F.lit('"join_key":'), user, F.lit(",")))
        .when(kind == 47, F.lit('"join_key":{"a":1},'))
        .when(kind == 31, F.concat(F.lit('"join_key":"zzz","join_key":"'), user, F.lit('",')))
        .otherwise(F.concat(F.lit('"join_key":"'), user, F.lit('",')))
    )
    body = F.when(kind == 39, '"payload":"text"').otherwise(
        F.concat(F.lit('"payload":{"action":"'), F.col("event_type"), F.lit('"}'))
    )
    rest = F.concat(
        F.lit('"value":'), F.col("value").cast("string"),
        F.lit(',"k":'), F.col("k").cast("string"), F.lit(","), body,
    )
    value = (
        F.when(kind == 7, F.concat(F.lit('{"event_id": broken '), F.col("event_id").cast("string")))
        .when(kind == 23, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")))
        .otherwise(
            F.concat(F.lit("{"), F.when(kind == 37, "").otherwise(event_id), time, key, rest, F.lit("}"))
        )
    )
    return e.select(value.alias("value"), "topic", "partition", "offset", "arrived_at")


RAW = f"""{EV},
pieces AS (
  SELECT *, event_id % 50 AS kind,
    strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM ev),
raw AS (
  SELECT *, CASE
    WHEN kind = 7 THEN '{{"event_id": broken ' || event_id
    WHEN kind = 23 THEN '[' || event_id || ']'
    ELSE '{{' || CASE WHEN kind = 37 THEN '' ELSE '"event_id":"' || event_id || '",' END
      || CASE WHEN kind = 17 THEN ''
              WHEN kind = 19 THEN '"event_time":"not-a-time",'
              WHEN kind = 41 THEN '"event_time":true,'
              WHEN kind = 1 THEN '"event_time":1e' || (20 + event_id % 300) || ','
              WHEN kind = 3 THEN '"event_time":' || rpad(CAST(event_id + 1 AS VARCHAR), 29, '0') || ','
              WHEN kind = 2 THEN '"event_time":"' || replace(iso, 'T', ' ') || '",'
              WHEN kind = 4 THEN '"event_time":"' || iso || '",'
              WHEN kind = 6 THEN '"event_time":"'
                || strftime(make_timestamp(us + 7200000000), '%Y-%m-%dT%H:%M:%S.%f') || '+02:00",'
              WHEN kind = 8 THEN '"event_time":"' || replace(replace(iso, '-', ''), ':', '') || '",'
              WHEN kind % 2 = 0 THEN '"event_time":"' || iso || 'Z",'
              ELSE '"event_time":' || (us // 1000000) || '.'
                || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') || ',' END
      || CASE WHEN kind = 11 THEN '' WHEN kind = 13 THEN '"join_key":"",'
              WHEN kind = 29 THEN '"join_key":0,'
              WHEN kind = 43 THEN '"join_key":' || user_id || ','
              WHEN kind = 47 THEN '"join_key":{{"a":1}},'
              WHEN kind = 31 THEN '"join_key":"zzz","join_key":"' || user_id || '",'
              ELSE '"join_key":"' || user_id || '",' END
      || '"value":' || value || ',"k":' || k || ','
      || CASE WHEN kind = 39 THEN '"payload":"text"'
              ELSE '"payload":{{"action":"' || event_type || '"}}' END || '}}' END AS msg
  FROM pieces)"""

ERROR = """CASE
    WHEN kind = 7 THEN 'Malformed JSON message'
    WHEN kind = 23 THEN 'Message is not a JSON object'
    WHEN kind IN (11, 13, 29) OR (kind = 43 AND user_id = 0) THEN 'Missing or empty ''join_key'' field'
    WHEN kind = 47 THEN 'Field ''join_key'' is not a scalar'
    WHEN kind = 17 THEN 'Missing ''event_time'' field'
    WHEN kind IN (1, 3, 19, 41) THEN 'Invalid ''event_time'' field' END"""


@query(
    "ingest_parse",
    f"""WITH {RAW}
SELECT CASE WHEN kind = 37 THEN '{TOPIC}-' || part || '-' || off
            ELSE CAST(event_id AS VARCHAR) END AS event_id,
       us AS event_time_us, arr AS ingest_time_us, CAST(user_id AS VARCHAR) AS join_key,
       msg AS payload_json, '{TOPIC}' AS source_topic, part AS "partition", off AS "offset"
FROM raw WHERE {ERROR} IS NULL""",
)
def ingest_parse(spark, sf_dir):
    parsed = ingest.fact_events(ingest.decode(raw_messages(spark, sf_dir)))
    return _in_micros(parsed, "event_time", "ingest_time")


@query(
    "dead_letter",
    f"""WITH {RAW}
SELECT msg AS original_message, {ERROR} AS error, arr AS timestamp_us, '{TOPIC}' AS source_topic,
       part AS "partition", off AS "offset"
FROM raw WHERE {ERROR} IS NOT NULL""",
)
def dead_letter(spark, sf_dir):
    return _in_micros(ingest.dead_letters(ingest.decode(raw_messages(spark, sf_dir))), "timestamp")


@query(
    "event_time_norm",
    f"""WITH {RAW}
SELECT part AS "partition", off AS "offset",
       CASE WHEN kind IN (1, 3, 17, 19, 41) THEN NULL ELSE us END AS event_time_us
FROM raw WHERE kind NOT IN (7, 23)""",
)
def event_time_norm(spark, sf_dir):
    body = payload.body("value")
    return (
        raw_messages(spark, sf_dir)
        .withColumn("_body", body)
        .filter(payload.kind(F.col("_body")) == "OBJECT")
        .withColumn("event_time", ingest.event_time(payload.field(F.col("_body"), "event_time")))
        .select("partition", "offset", F.unix_micros("event_time").alias("event_time_us"))
    )


def _in_micros(frame: DataFrame, *names: str) -> DataFrame:
    return frame.select(
        *[
            F.unix_micros(c).alias(f"{c}_us") if c in names else F.col(c)
            for c in frame.columns
        ]
    )


def checked_facts(spark, sf_dir: str) -> DataFrame:
    """Fact events where a sign-up without k = 0 has a key and errors keep their partition."""
    return (
        data.measured_facts(spark, sf_dir)
        .withColumn("join_key", F.when(F.col("k") == 0, "").otherwise(F.col("join_key")))
        .withColumn("partition", F.when(F.col("k") == 1, -1).otherwise(F.col("partition")))
        .withColumn("offset", F.when(F.col("k") == 2, -F.col("offset") - 1).otherwise(F.col("offset")))
    )


@query(
    "valid_events",
    f"""WITH {EV}, c AS (
  SELECT event_id, list_filter([
    CASE WHEN us > epoch_us(TIMESTAMP '2024-01-25 00:05:00') THEN 'event_time_in_future' END,
    CASE WHEN k = 0 THEN 'empty_join_key' END,
    CASE WHEN k = 1 THEN 'negative_partition' END,
    CASE WHEN k = 2 THEN 'negative_offset' END], lambda x: x IS NOT NULL) AS v FROM ev)
SELECT CAST(event_id AS VARCHAR) AS event_id, array_to_string(v, ',') AS violations,
       len(v) = 0 AS is_valid FROM c""",
)
def valid_events(spark, sf_dir):
    rows = checked(checked_facts(spark, sf_dir), validation.event_rules(NOW))
    return rows.select(
        "event_id",
        F.concat_ws(",", "violations").alias("violations"),
        (F.size("violations") == 0).alias("is_valid"),
    )


@query(
    "valid_event_counts",
    f"""WITH {EV}, c AS (
  SELECT unnest([
    CASE WHEN us > epoch_us(TIMESTAMP '2024-01-25 00:05:00') THEN 'event_time_in_future' END,
    CASE WHEN k = 0 THEN 'empty_join_key' END,
    CASE WHEN k = 1 THEN 'negative_partition' END,
    CASE WHEN k = 2 THEN 'negative_offset' END,
    CASE WHEN us <= epoch_us(TIMESTAMP '2024-01-25 00:05:00') AND k NOT IN (0, 1, 2)
         THEN 'valid' END]) AS outcome FROM ev)
SELECT outcome, count(*) AS n_rows FROM c WHERE outcome IS NOT NULL GROUP BY outcome""",
)
def valid_event_counts(spark, sf_dir):
    return violation_counts(checked_facts(spark, sf_dir), validation.event_rules(NOW))


@query(
    "payload_conformance",
    f"""WITH {RAW}, j AS (
  SELECT kind, CASE WHEN json_valid(msg) THEN msg END AS msg FROM raw),
t AS (
  SELECT kind, json_type(msg) AS body, json_type(msg, '$.event_id') AS id,
         json_type(msg, '$.event_time') AS tm, json_type(msg, '$.payload') AS pl,
         CASE WHEN kind = 31 THEN 'VARCHAR' ELSE json_type(msg, '$.join_key') END AS jk,
         CASE WHEN kind = 31 THEN 'k' ELSE json_extract_string(msg, '$.join_key') END AS jv
  FROM j),
r AS (
  SELECT body IS NOT NULL AND body = 'OBJECT' AND id IS NOT NULL AND id = 'VARCHAR'
     AND tm IS NOT NULL AND tm = 'VARCHAR' AND jk IS NOT NULL AND jk = 'VARCHAR'
     AND length(jv) >= 1 AND pl IS NOT NULL AND pl = 'OBJECT' AS conforms FROM t)
SELECT conforms, count(*) AS n_messages FROM r GROUP BY conforms""",
)
def payload_conformance(spark, sf_dir):
    return (
        raw_messages(spark, sf_dir)
        .select(payload.body("value").alias("_body"))
        .groupBy(validation.conforms(F.col("_body")).alias("conforms"))
        .agg(F.count("*").alias("n_messages"))
    )


@query(
    "payload_violations",
    f"""WITH {RAW}, c AS (
  SELECT unnest([
    CASE WHEN kind IN (7, 23) THEN 'not_an_object' END,
    CASE WHEN kind = 37 THEN 'missing_event_id' END,
    CASE WHEN kind = 17 THEN 'missing_event_time' END,
    CASE WHEN kind % 2 = 1 AND kind NOT IN (7, 17, 19, 23) THEN 'event_time_not_string' END,
    CASE WHEN kind = 11 THEN 'missing_join_key' END,
    CASE WHEN kind IN (29, 43, 47) THEN 'join_key_not_string' END,
    CASE WHEN kind = 13 THEN 'join_key_too_short' END,
    CASE WHEN kind = 39 THEN 'payload_not_object' END,
    CASE WHEN kind % 2 = 0 OR kind = 19 THEN 'valid' END]) AS outcome FROM raw)
SELECT outcome, count(*) AS n_rows FROM c WHERE outcome IS NOT NULL GROUP BY outcome""",
)
def payload_violations(spark, sf_dir):
    bodies = raw_messages(spark, sf_dir).select(payload.body("value").alias("_body"))
    return violation_counts(bodies, validation.body_rules(F.col("_body")))


@query(
    "schema_drift",
    f"""WITH {RAW}, o AS (SELECT * FROM raw WHERE kind NOT IN (7, 23)), n AS (
  SELECT 'event_id' AS field, count(*) FILTER (kind = 37) AS n_lacking FROM o UNION ALL
  SELECT 'event_time', count(*) FILTER (kind = 17) FROM o UNION ALL
  SELECT 'join_key', count(*) FILTER (kind = 11) FROM o UNION ALL
  SELECT 'payload', 0 FROM o WHERE false UNION ALL
  SELECT 'region', count(*) FROM o)
SELECT * FROM n WHERE n_lacking > 0""",
)
def schema_drift(spark, sf_dir):
    expected = [*validation.REQUIRED_FIELDS, "region"]
    return validation.missing_fields(raw_messages(spark, sf_dir), expected)


@query(
    "field_profile",
    f"""WITH {RAW}, o AS (SELECT * FROM raw WHERE kind NOT IN (7, 23)),
f AS (
  SELECT 'event_id' AS field, 'STRING' AS json_type FROM o WHERE kind <> 37 UNION ALL
  SELECT 'event_time', CASE WHEN kind = 41 THEN 'BOOLEAN'
                            WHEN kind = 1 THEN 'DOUBLE'
                            WHEN kind % 2 = 0 OR kind = 19 THEN 'STRING'
                            WHEN us % 1000000 = 0 THEN 'DECIMAL' ELSE 'DECIMAL' END
  FROM o WHERE kind <> 17 UNION ALL
  SELECT 'join_key', CASE WHEN kind IN (29, 43) THEN 'BIGINT' WHEN kind = 47 THEN 'OBJECT'
                          ELSE 'STRING' END FROM o WHERE kind <> 11 UNION ALL
  SELECT 'k', 'BIGINT' FROM o UNION ALL
  SELECT 'value', 'DECIMAL' FROM o UNION ALL
  SELECT 'payload', CASE WHEN kind = 39 THEN 'STRING' ELSE 'OBJECT' END FROM o)
SELECT field, json_type, count(*) AS n_messages,
       {snap_sql('count(*) / (SELECT count(*) FROM o)', 6)} AS share
FROM f GROUP BY field, json_type""",
)
def field_profile(spark, sf_dir):
    profile = validation.field_profile(raw_messages(spark, sf_dir))
    return profile.withColumn("share", snap("share", 6))


@query(
    "row_project",
    f"""WITH {EV} SELECT event_id, json_extract_string(j, '$.event_type') AS event_type,
       CAST(json_extract(j, '$.k') AS BIGINT) AS k, 5 AS n_keys
FROM (SELECT event_id, json_object('event_type', event_type, 'k', k) AS j FROM ev)""",
)
def row_project(spark, sf_dir):
    rows = data.events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", "k")
    text = ingest.row_json(rows)
    return text.select(
        F.get_json_object("row_json", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("row_json", "$.event_type").alias("event_type"),
        F.get_json_object("row_json", "$.k").cast("bigint").alias("k"),
        F.size(F.json_object_keys("row_json")).alias("n_keys"),
    )


@query(
    "numeric_fields",
    f"""WITH {EV}
SELECT CAST(event_id AS VARCHAR) AS event_id, 'value' AS field, value AS value FROM ev
UNION ALL SELECT CAST(event_id AS VARCHAR), 'k', CAST(k AS DOUBLE) FROM ev""",
)
def numeric_fields(spark, sf_dir):
    return payload.numeric_fields(data.facts(spark, sf_dir), ["event_id"])
