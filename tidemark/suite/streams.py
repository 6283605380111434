"""Streaming queries, run to the end of the supplied events and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.corrections import latest
from tidemark.plans.durable import scratch_path, written
from tidemark.schemas import ARRIVAL_ORDER, RAW_MESSAGE
from tidemark.sources import messages
from tidemark.sources.dimension_table import DimensionTable
from tidemark.sources.store import metrics_of
from tidemark.streaming import temporal
from tidemark.streaming.jobs import Flow
from tidemark.streaming.progress import REPORT
from tidemark.streaming.state import set_state_store
from tidemark.suite import data
from tidemark.suite.data import DIM, EV, HOURLY, LATENESS, spread_sql, window_id_sql
from tidemark.suite.ingest import ERROR, RAW, raw_messages
from tidemark.suite.registry import ORACLES, once, query, snap, snap_sql

ID = window_id_sql(HOURLY)
SIZE = HOURLY.size
L = LATENESS * 1_000_000
# Arrivals are handed to the flow in stretches of ten days, one micro-batch each.
STRETCH = 10 * 86_400 * 1_000_000
ORIGIN_SQL = "epoch_us(TIMESTAMP '2024-01-01')"


@once
def finished_flow(spark, sf_dir: str) -> Flow:
    """The whole flow over the raw messages, started again after each stretch has landed."""
    root = scratch_path(spark, "flow")
    land = f"{root}/landing"
    table = written(data.dimension_table(spark, sf_dir), "dimension")
    flow = Flow(
        spark,
        f"{root}/out",
        HOURLY,
        None,
        LATENESS,
        dimension=lambda _: table,
        attribute_types=data.attribute_types(spark, sf_dir),
        attribute_fields=["price"],
    )
    reports = flow.reports()
    raw = raw_messages(spark, sf_dir).to(RAW_MESSAGE)
    origin = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    stretch = F.floor((F.unix_micros("arrived_at") - origin) / STRETCH)
    bounds = raw.agg(F.min(stretch).alias("first"), F.max(stretch).alias("last")).first()
    for number in range(bounds["first"] or 0, (-1 if bounds["last"] is None else bounds["last"]) + 1):
        raw.filter(stretch == number).write.mode("append").parquet(land)
        flow.start(messages.landed(spark, land, streaming=True)).awaitTermination()
    reports.wait()
    spark.streams.removeListener(reports)
    return flow


FLOW = f"""{RAW},
good AS (SELECT *, (arr - {ORIGIN_SQL}) // {STRETCH} AS b FROM raw WHERE {ERROR} IS NULL),
marks AS (SELECT b, max(us) - {L} AS top FROM good GROUP BY b),
bounds AS (SELECT b, max(top) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm0,
  max(top) OVER (ORDER BY b) AS wm1 FROM marks),
fed AS (SELECT good.*, wm0, wm0 IS NULL OR us >= wm0 - {L} AS accepted FROM good JOIN bounds USING (b)),
spread AS (SELECT * FROM {spread_sql('fed', HOURLY)}),
v0 AS (SELECT s, count(*) AS n, sum(value) AS v FROM spread
  WHERE accepted AND (wm0 IS NULL OR s + {SIZE} > wm0) GROUP BY s
  HAVING s + {SIZE} <= (SELECT max(wm1) FROM bounds)),
late AS (SELECT s, b, count(*) AS n, sum(value) AS v FROM spread WHERE s + {SIZE} <= wm0 GROUP BY s, b),
corr AS (SELECT late.s, row_number() OVER w AS version, v0.n + sum(late.n) OVER w AS n,
  v0.v + sum(late.v) OVER w AS v
  FROM late JOIN v0 ON late.s = v0.s WINDOW w AS (PARTITION BY late.s ORDER BY b)),
flow_results AS (SELECT s, 0 AS version, n, v FROM v0 UNION ALL SELECT s, version, n, v FROM corr)"""


@query(
    "stream_windows",
    f"""WITH {FLOW} SELECT {ID} AS window_id, CAST(n AS INTEGER) AS event_count,
       {snap_sql('v', 2)} AS value_sum FROM v0""",
)
def stream_windows(spark, sf_dir):
    """First results of closed windows, fed in order of arrival, events behind the lateness left out."""
    results = finished_flow(spark, sf_dir).store.window_results().filter("correction_version = 0")
    rows = metrics_of(results).filter("metric = 'value_sum'")
    return rows.select(
        "window_id", "event_count", snap("metric_value", 2).alias("value_sum")
    )


@query(
    "stream_corrections",
    f"""WITH {FLOW} SELECT {ID} AS window_id, CAST(version AS INTEGER) AS correction_version,
       version > 0 AS is_correction, CAST(n AS INTEGER) AS event_count, {snap_sql('v', 2)} AS value_sum
FROM flow_results""",
)
def stream_corrections(spark, sf_dir):
    results = finished_flow(spark, sf_dir).store.window_results()
    rows = metrics_of(results).filter("metric = 'value_sum'")
    return rows.select(
        "window_id",
        "correction_version",
        "is_correction",
        "event_count",
        snap("metric_value", 2).alias("value_sum"),
    )


@query(
    "stream_latest",
    f"""WITH {FLOW}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY version DESC) AS rn
  FROM flow_results)
SELECT {ID} AS window_id, CAST(version AS INTEGER) AS correction_version,
       CAST(n AS INTEGER) AS event_count FROM r WHERE rn = 1""",
)
def stream_latest(spark, sf_dir):
    rows = latest(finished_flow(spark, sf_dir).store.window_results())
    return rows.select("window_id", "correction_version", "event_count")


@query(
    "stream_batch_reports",
    f"""WITH {RAW}, f AS (SELECT (arr - {ORIGIN_SQL}) // {STRETCH} AS b, count(*) AS n FROM raw GROUP BY b)
SELECT row_number() OVER (ORDER BY b) - 1 AS batch_id, n AS n_rows, true AS has_times, 0 AS late_rows_dropped FROM f""",
)
def stream_batch_reports(spark, sf_dir):
    """Spark's account of each batch of messages. No state drops late rows: they correct closed windows."""
    flow = finished_flow(spark, sf_dir)
    rows = spark.read.schema(REPORT).json(f"{flow.root}/reports")
    dropped = rows.filter("query = 'flow-windows'").agg(F.coalesce(F.sum("late_rows_dropped"), F.lit(0)))
    return rows.filter("query = 'flow-ingest' and n_rows > 0").select(
        "batch_id",
        "n_rows",
        ((F.col("trigger_ms") > 0) & (F.col("steps_ms")["addBatch"] <= F.col("trigger_ms"))).alias("has_times"),
        dropped.scalar().cast("int").alias("late_rows_dropped"),
    )


MEASURED = [("value", "value"), ("k", "k"), ("price", "price")]
PARTS = ["sum", "min", "max"]


def _measures(merge: str) -> str:
    return ", ".join(merge.format(part=part, name=name) for name, _ in MEASURED for part in PARTS)


@query(
    "stream_found_fields",
    f"""WITH {DIM}, {FLOW},
fedp AS (SELECT fed.*, dim.price FROM fed LEFT JOIN dim ON dim.key = CAST(user_id AS VARCHAR) AND dim.is_active),
spreadp AS (SELECT * FROM {spread_sql('fedp', HOURLY)}),
firsts AS (SELECT s, 0 AS b, 0 AS version, {_measures('{part}({name}) AS {name}_{part}')} FROM spreadp
  WHERE accepted AND (wm0 IS NULL OR s + {SIZE} > wm0) AND s IN (SELECT s FROM v0) GROUP BY s),
lates AS (SELECT s, b, 1 AS version, {_measures('{part}({name}) AS {name}_{part}')} FROM spreadp
  WHERE s + {SIZE} <= wm0 AND s IN (SELECT s FROM v0) GROUP BY s, b),
versions AS (SELECT s, sum(version) OVER w AS version, {_measures('{part}({name}_{part}) OVER w AS {name}_{part}')}
  FROM (SELECT s, -1 AS b, * EXCLUDE (s, b) FROM firsts UNION ALL SELECT s, b, * EXCLUDE (s, b) FROM lates)
  WINDOW w AS (PARTITION BY s ORDER BY b)),
long AS (UNPIVOT (SELECT s, version, {_measures('CAST({name}_{part} AS DOUBLE) AS {name}_{part}')} FROM versions)
  ON COLUMNS(* EXCLUDE (s, version)) INTO NAME metric VALUE metric_value)
SELECT {ID} AS window_id, CAST(version AS INTEGER) AS correction_version, metric,
       {snap_sql('metric_value', 2)} AS metric_value FROM long""",
)
def stream_found_fields(spark, sf_dir):
    """Every version of the fields found in the messages, and of an attribute of the dimension."""
    rows = metrics_of(finished_flow(spark, sf_dir).store.window_results())
    return rows.filter("metric <> 'count' and not endswith(metric, '_avg')").select(
        "window_id", "correction_version", "metric", snap("metric_value", 2).alias("metric_value")
    )


@query(
    "stream_end_to_end",
    f"""WITH {DIM}, {FLOW}, rows_out AS (
  SELECT 'joined' AS outcome, CASE WHEN kind = 37 THEN '{data.TOPIC}-' || part || '-' || off
           ELSE CAST(event_id AS VARCHAR) END AS event_id, order_key, CAST(NULL AS VARCHAR) AS error
  FROM fed LEFT JOIN dim ON dim.key = CAST(user_id AS VARCHAR) AND dim.is_active WHERE accepted
  UNION ALL
  SELECT 'late', CASE WHEN kind = 37 THEN '{data.TOPIC}-' || part || '-' || off
           ELSE CAST(event_id AS VARCHAR) END, NULL, NULL FROM fed WHERE NOT accepted
  UNION ALL
  SELECT 'dead', part || '-' || off, NULL, {ERROR} FROM raw WHERE {ERROR} IS NOT NULL)
SELECT * FROM rows_out""",
)
def stream_end_to_end(spark, sf_dir):
    flow = finished_flow(spark, sf_dir)
    nothing = F.lit(None).cast("string").alias("error")
    joined = flow.store.joined_events().select(
        F.lit("joined").alias("outcome"),
        "event_id",
        F.get_json_object("dimension_attrs_json", "$.order_key").cast("bigint").alias("order_key"),
        nothing,
    )
    late = flow.table("late_events").select(
        F.lit("late").alias("outcome"), "event_id", F.lit(None).cast("bigint").alias("order_key"), nothing
    )
    dead = flow.table("dead_letters").select(
        F.lit("dead").alias("outcome"),
        F.concat_ws("-", "partition", "offset").alias("event_id"),
        F.lit(None).cast("bigint").alias("order_key"),
        "error",
    )
    return joined.unionByName(late).unionByName(dead)


@once
def standing_dimension(spark, sf_dir: str) -> DimensionTable:
    """The change log landed in three stretches, each merged into the standing table as a batch."""
    root = scratch_path(spark, "changes")
    changes = data.changes(spark, sf_dir)
    top = changes.agg(F.max("seq")).first()[0] or 0
    table = DimensionTable(spark, f"{root}/table", n_buckets=8, max_deltas=1)
    for number in range(3):
        part = F.least(F.floor(F.greatest("seq", F.lit(0)) * 3 / (top + 1)), F.lit(2))
        changes.filter(part == number).write.mode("append").parquet(f"{root}/landing")
        table.start(messages.dimension_changes(spark, f"{root}/landing", streaming=True)).awaitTermination()
    return table


@query(
    "dim_changelog",
    f"WITH {DIM} SELECT key AS dimension_key, version, is_active FROM dim",
)
def dim_changelog(spark, sf_dir):
    """The change log consumed as a stream into the standing table."""
    return standing_dimension(spark, sf_dir).table().select("dimension_key", "version", "is_active")


@query(
    "dim_point_lookup",
    f"""WITH {DIM} SELECT key AS dimension_key, version, is_active, order_key FROM dim
WHERE key IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'purchase')""",
)
def dim_point_lookup(spark, sf_dir):
    """The standing table's rows for the keys of some events."""
    buyers = data.events(spark, sf_dir).filter("event_type = 'purchase'")
    keys = buyers.select(F.col("user_id").cast("string").alias("dimension_key"))
    return standing_dimension(spark, sf_dir).lookup(keys).select(
        "dimension_key",
        "version",
        "is_active",
        F.get_json_object("attributes_json", "$.order_key").cast("bigint").alias("order_key"),
    )


@once
def live_as_of(spark, sf_dir: str):
    """Facts and changes landed in four stretches each, in turn; positions count as seconds."""
    root = scratch_path(spark, "as-of")
    set_state_store(spark)
    moment = lambda position: F.timestamp_micros(position * 1_000_000).alias("moment")
    position = F.col("offset") * 3 + F.col("partition")
    facts = data.facts(spark, sf_dir).select("event_id", "join_key", *ARRIVAL_ORDER, moment(position))
    changes = data.changes(spark, sf_dir).select("*", moment(F.col("seq")))
    paths = {name: f"{root}/{name}" for name in ("facts", "changes")}
    frames = {"facts": facts, "changes": changes}
    top = facts.agg(F.max(F.unix_seconds("moment"))).first()[0] or 0
    fact_schema, change_schema = facts.schema, changes.schema
    # The last stretch moves both watermarks past every fact; its rows are of no key.
    end = F.timestamp_micros(F.lit((10 * top + 10) * 1_000_000)).alias("moment")
    for number in range(5):
        for name, frame in frames.items():
            share = F.least(F.floor(F.greatest(F.unix_seconds("moment"), F.lit(0)) * 4 / (top + 1)), F.lit(3))
            part = frame.filter(share == number)
            if number == 4:
                part = frame.limit(1).select(
                    *[end if c == "moment" else F.lit("no-one").alias(c) if c.endswith("_key") else c for c in frame.columns]
                )
            part.write.mode("append").parquet(paths[name])
        joined = temporal.enrich_as_of(
            spark.readStream.schema(fact_schema).parquet(paths["facts"]),
            spark.readStream.schema(change_schema).parquet(paths["changes"]),
            "moment",
            "moment",
            buckets=8,
        )
        run = (
            joined.writeStream.format("parquet")
            .option("path", f"{root}/joined")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return spark.read.schema(joined.schema).parquet(f"{root}/joined")


@query("stream_enrich_as_of", ORACLES["enrich_as_of"])
def stream_enrich_as_of(spark, sf_dir):
    """The as-of join of both logs as live streams, fed in turn."""
    return live_as_of(spark, sf_dir).select(
        "event_id",
        "version",
        F.get_json_object("attributes_json", "$.order_key").cast("bigint").alias("order_key"),
        F.get_json_object("attributes_json", "$.name").alias("name"),
    )
