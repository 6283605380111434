"""Queries on the watermark, lateness and window closing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import watermark
from tidemark.schemas import ARRIVAL_ORDER
from tidemark.suite import data
from tidemark.suite.data import EV, HOURLY, IDLE, LATENESS, REPLAY, WM, window_id_sql
from tidemark.suite.registry import query, snap, snap_sql

SECOND = 1_000_000
L = LATENESS * SECOND


def _timed(spark, sf_dir):
    """Events without their bodies, which would travel through the ordered ranges."""
    return data.facts(spark, sf_dir).select("event_id", "event_time", *ARRIVAL_ORDER)


@query(
    "watermark_running",
    f"WITH {WM} SELECT CAST(event_id AS VARCHAR) AS event_id, wm AS watermark_us FROM wm",
)
def watermark_running(spark, sf_dir):
    rows = watermark.replay(_timed(spark, sf_dir), LATENESS)
    return rows.select("event_id", F.unix_micros("watermark").alias("watermark_us"))


@query(
    "lateness_split",
    f"WITH {WM} SELECT CAST(event_id AS VARCHAR) AS event_id, decision FROM wm",
)
def lateness_split(spark, sf_dir):
    return data.replayed(spark, sf_dir).select("event_id", "decision")


@query(
    "late_dropped_count",
    f"WITH {WM} SELECT count(*) FILTER (decision = 'drop') AS late_dropped_count FROM wm",
)
def late_dropped_count(spark, sf_dir):
    return watermark.dropped_count(data.replayed(spark, sf_dir))


@query(
    "watermark_idle",
    f"""WITH {EV}, gaps AS (
  SELECT *, lag(arr) OVER (ORDER BY arr, part, off) AS prev FROM ev),
cand AS (SELECT *, CASE WHEN arr - prev > {IDLE * SECOND} THEN arr - {IDLE * SECOND} END AS idle FROM gaps),
run AS (SELECT *, greatest(max(us) OVER o - {L}, max(idle) OVER o) AS wm FROM cand
  WINDOW o AS (ORDER BY arr, part, off ROWS UNBOUNDED PRECEDING))
SELECT CAST(event_id AS VARCHAR) AS event_id, wm AS watermark_us, idle AS idle_watermark_us,
       CASE WHEN us >= wm - {L} THEN 'accept' ELSE 'drop' END AS decision FROM run""",
)
def watermark_idle(spark, sf_dir):
    rows = watermark.replay(_timed(spark, sf_dir), LATENESS, IDLE)
    return rows.select(
        "event_id",
        F.unix_micros("watermark").alias("watermark_us"),
        F.unix_micros("idle_watermark").alias("idle_watermark_us"),
        "decision",
    )


@query(
    "watermark_lag",
    f"""WITH {WM} SELECT CAST(event_id AS VARCHAR) AS event_id,
       greatest((arr - wm) / 1e6, 0.0) AS lag_seconds FROM wm""",
)
def watermark_lag(spark, sf_dir):
    return watermark.with_lag(data.replayed(spark, sf_dir)).select("event_id", "lag_seconds")


TICK = 60 * SECOND


@query(
    "watermark_ticks",
    f"""WITH {WM}, busy AS (
  SELECT arr // {TICK} * {TICK} + {TICK} AS tick, max(wm) AS wm FROM wm GROUP BY 1),
spine AS (SELECT unnest(generate_series(min(tick), max(tick), {TICK})) AS tick FROM busy),
run AS (SELECT tick, max(wm) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS wm
  FROM spine LEFT JOIN busy USING (tick))
SELECT tick AS wall_clock_us, wm AS watermark_us,
       {snap_sql('greatest((tick - wm) / 1e6, 0.0)', 6)} AS lag_seconds FROM run""",
)
def watermark_ticks(spark, sf_dir):
    rows = watermark.ticks(data.replayed(spark, sf_dir), every_seconds=60)
    return rows.select(
        F.unix_micros("wall_clock").alias("wall_clock_us"),
        F.unix_micros("watermark").alias("watermark_us"),
        snap("lag_seconds", 6).alias("lag_seconds"),
    )


@query(
    "closed_vs_open",
    f"""WITH {REPLAY} SELECT CAST(event_id AS VARCHAR) AS event_id,
       count(*) FILTER (s + {HOURLY.size} <= wm) AS n_closed,
       count(*) FILTER (s + {HOURLY.size} > wm) AS n_open FROM spread GROUP BY event_id""",
)
def closed_vs_open(spark, sf_dir):
    rows = watermark.closed_and_open(data.replayed(spark, sf_dir), HOURLY)
    return rows.select("event_id", "n_closed", "n_open")


@query(
    "close_points",
    f"""WITH {REPLAY}
SELECT {window_id_sql(HOURLY, 'closed.s')} AS window_id,
       (SELECT min(arr) FROM wm WHERE wm.wm >= closed.s + {HOURLY.size}) AS closed_at_us
FROM closed""",
)
def close_points(spark, sf_dir):
    rows = data.window_replay(spark, sf_dir).closed_with_time()
    return rows.select("window_id", F.unix_micros("emitted_at").alias("closed_at_us"))
