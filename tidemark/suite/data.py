"""The supplied tables in the roles the operators expect, in Spark and as SQL fragments.

The supplied ``events`` arrive in time order, so an arrival time is derived that delays each
event, some by up to two hours. The dimension log starts with a load of ``customer`` and goes on
with one change per order.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.payload import with_numbers
from tidemark.functions.times import SECOND, Windows
from tidemark.operators import dimension, enrich
from tidemark.operators.corrections import WindowReplay
from tidemark.plans.sizing import dealt
from tidemark.schemas import ARRIVAL_ORDER, FACT_COLUMNS
from tidemark.suite.registry import once

TOPIC = "fact-events"
FIELDS = ["value", "k"]
HOURLY = Windows(3600, 900)
FIVE_MINUTES = Windows(300, 300)
LATENESS = 600
IDLE = 900
LOADED_AT = datetime(1995, 1, 1, tzinfo=timezone.utc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied events with UTC ``event_time``, ``arrived_at``, topic, partition and offset."""
    delay = F.when(
        F.col("event_id") % 10 == 0, (F.col("event_id") * 7919) % 7200
    ).otherwise(F.col("event_id") % 60)
    event_us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.timestamp_micros(event_us).alias("event_time"),
        F.timestamp_micros(event_us + delay * SECOND).alias("arrived_at"),
        F.lit(TOPIC).alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.expr("event_id div 3").alias("offset"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplied event as a fact event."""
    return events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"),
        "event_time",
        F.col("arrived_at").alias("ingest_time"),
        F.col("user_id").cast("string").alias("join_key"),
        F.to_json(F.struct("event_type", "value", "k")).alias("payload_json"),
        F.col("topic").alias("source_topic"),
        "partition",
        "offset",
    ).select(*FACT_COLUMNS)


def measured_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact events with their numeric payload fields as columns."""
    return with_numbers(dealt(facts(spark, sf_dir), "event_id"), FIELDS)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension log: a load of all customers, then an upsert or delete per order."""
    records = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )
    load = dimension.load_changes(records, "user_id", F.lit(-1), F.lit(LOADED_AT))
    updates = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("dimension_key"),
        F.when(F.col("o_orderkey") % 11 == 0, "delete").otherwise("upsert").alias("op"),
        F.to_json(
            F.struct(
                F.col("o_totalprice").alias("price"),
                F.col("o_orderpriority").alias("priority"),
                F.col("o_orderkey").alias("order_key"),
            )
        ).alias("attributes_json"),
        (F.col("o_orderkey") % 7 + 1).alias("version"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )
    return load.unionByName(updates)


@once
def attribute_types(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Every attribute that the dimension log names, with its type."""
    return enrich.attribute_types(changes(spark, sf_dir))


def dimension_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension.replay(changes(spark, sf_dir))


@once
def window_replay(spark: SparkSession, sf_dir: str) -> WindowReplay:
    """The watermark replay shared by the window queries."""
    events = measured_facts(spark, sf_dir).select("event_id", "event_time", *ARRIVAL_ORDER, *FIELDS)
    return WindowReplay.of(events, HOURLY, FIELDS, LATENESS)


@once
def found_fields_replay(spark: SparkSession, sf_dir: str) -> WindowReplay:
    """A replay that finds its fields: ``value`` in every payload and one of five names beside it."""
    text = F.concat(
        F.lit('{"value":'), F.col("value").cast("string"), F.lit(',"kind_'),
        (F.col("event_id") % 5).cast("string"), F.lit('":'), F.col("k").cast("string"), F.lit("}"),
    )
    rows = events(spark, sf_dir).select(
        "event_time", F.col("arrived_at").alias("ingest_time"), "partition", "offset", text.alias("payload_json")
    )
    return WindowReplay.of(rows, HOURLY, None, LATENESS)


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_replay(spark, sf_dir).replayed


# -- SQL fragments ---------------------------------------------------------------------------------

EV = """
ev AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         epoch_us(ts) AS us,
         epoch_us(ts) + 1000000 * CASE WHEN event_id % 10 = 0 THEN (event_id * 7919) % 7200
                                       ELSE event_id % 60 END AS arr,
         CAST(event_id % 3 AS INTEGER) AS part, event_id // 3 AS off
  FROM events)"""

CHANGES = """
chg AS (
  SELECT CAST(c_custkey AS VARCHAR) AS key, 'upsert' AS op, CAST(1 AS BIGINT) AS version,
         CAST(-1 AS BIGINT) AS seq, c_name AS name, c_mktsegment AS segment,
         c_acctbal AS balance, NULL AS price, NULL AS priority, NULL AS order_key,
         TIMESTAMP '1995-01-01' AS updated_at
  FROM customer
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'upsert' END,
         o_orderkey % 7 + 1, o_orderkey, NULL, NULL, NULL, o_totalprice, o_orderpriority,
         o_orderkey, o_orderdate
  FROM orders)"""

DIM = f"""{CHANGES},
dim AS (
  SELECT w.*, NOT EXISTS (SELECT 1 FROM chg d WHERE d.key = w.key AND d.op = 'delete'
                          AND d.seq > w.seq) AS is_active
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq) AS rn
        FROM chg WHERE op = 'upsert') w
  WHERE rn = 1)"""

WM = f"""{EV},
wm AS (
  SELECT *, CASE WHEN us >= wm - {LATENESS * SECOND} THEN 'accept' ELSE 'drop' END AS decision
  FROM (SELECT *, max(us) OVER (ORDER BY arr, part, off ROWS UNBOUNDED PRECEDING)
                  - {LATENESS * SECOND} AS wm FROM ev))"""


def first_start_sql(us: str, windows: Windows) -> str:
    return f"(({us} - {windows.size}) // {windows.slide} * {windows.slide} + {windows.slide})"


def last_start_sql(us: str, windows: Windows) -> str:
    return f"({us} // {windows.slide} * {windows.slide})"


def spread_sql(source: str, windows: Windows, us: str = "us") -> str:
    """``source`` with one row per window, its start in ``s``."""
    return (
        f"(SELECT *, unnest(generate_series({first_start_sql(us, windows)}, "
        f"{last_start_sql(us, windows)}, {windows.slide})) AS s FROM {source})"
    )


def window_id_sql(windows: Windows, start: str = "s") -> str:
    end = f"({start} + {windows.size})"
    return f"({start} // 1000000) || '.0_' || ({end} // 1000000) || '.0'"


# Fixed window pieces of the replay queries: v0 per window and late rows per (event, window).
REPLAY = f"""{WM},
spread AS (SELECT * FROM {spread_sql('wm', HOURLY)}),
v0 AS (
  SELECT s, count(*) AS n, sum(value) AS value_sum, min(value) AS value_min,
         max(value) AS value_max, sum(k) AS k_sum, min(k) AS k_min, max(k) AS k_max
  FROM spread
  WHERE decision = 'accept' AND s + {HOURLY.size} > wm
  GROUP BY s),
closed AS (SELECT * FROM v0 WHERE s + {HOURLY.size} <= (SELECT max(wm) FROM wm)),
late AS (
  SELECT spread.*, closed.n AS n0, closed.value_sum AS value0, closed.value_min AS min0,
         closed.value_max AS max0, closed.k_sum AS k0
  FROM spread JOIN closed USING (s) WHERE s + {HOURLY.size} <= wm),
corr AS (
  SELECT s, arr, part, off, n0, value0, row_number() OVER w AS version,
         n0 + count(*) OVER w AS n, value0 + sum(value) OVER w AS value_sum,
         k0 + sum(k) OVER w AS k_sum,
         least(min0, min(value) OVER w) AS value_min, greatest(max0, max(value) OVER w) AS value_max
  FROM late WINDOW w AS (PARTITION BY s ORDER BY arr, part, off ROWS UNBOUNDED PRECEDING))"""
