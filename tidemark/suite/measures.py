"""Queries on throughput, latency, health and timelines."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.operators import metrics, quantiles, watermark
from tidemark.suite import data
from tidemark.suite.data import EV, HOURLY, REPLAY, WM
from tidemark.suite.registry import query, snap, snap_sql
from tidemark.suite.streams import FLOW, finished_flow

SECOND = 1_000_000
END = datetime(2024, 1, 31, tzinfo=timezone.utc)


@query(
    "throughput",
    f"""WITH {EV} SELECT arr // 1000000 * 1000000 AS span_us, count(*) AS n_events,
       CAST(count(*) AS DOUBLE) AS events_per_second FROM ev GROUP BY 1""",
)
def throughput(spark, sf_dir):
    rows = metrics.throughput(data.facts(spark, sf_dir))
    return rows.select(F.unix_micros("span_start").alias("span_us"), "n_events", "events_per_second")


@query(
    "join_throughput",
    f"""WITH {FLOW}, batches AS (SELECT b, count(*) FILTER (accepted) AS n_rows FROM fed GROUP BY b)
SELECT row_number() OVER (ORDER BY b) - 1 AS batch_id, n_rows, n_rows > 0 AS has_rate,
       true AS within_batch FROM batches""",
)
def join_throughput(spark, sf_dir):
    """Rows that each batch of the flow joined and stored, by the seconds of that step alone; the rate differs
    from run to run."""
    batches = finished_flow(spark, sf_dir).table("progress").select(
        F.col("batch_id").cast("bigint").alias("batch_id"),
        F.col("n_accepted").alias("n_rows"),
        F.col("join_seconds").alias("elapsed_seconds"),
        (F.col("join_seconds") < F.col("elapsed_seconds")).alias("within_batch"),
    )
    return metrics.batch_rates(batches).select(
        "batch_id", "n_rows", (F.col("rows_per_second") > 0).alias("has_rate"), "within_batch"
    )


@query(
    "exact_quantiles",
    f"""SELECT event_type, {snap_sql('quantile_cont(value, 0.5)', 4)} AS median,
       quantile_disc(value, 0.9) AS p90, {snap_sql('quantile_cont(value, 0.25)', 4)} AS q1
FROM events GROUP BY event_type""",
)
def exact_quantiles(spark, sf_dir):
    """The quantiles of few and large groups, each spread over many tasks."""
    rows = data.events(spark, sf_dir)
    found = quantiles.exact_quantiles(
        rows, ["event_type"], "value", ["event_id"], {"median": 0.5, "q1": 0.25}, {"p90": 0.9}
    )
    return found.select("event_type", snap("median", 4).alias("median"), "p90", snap("q1", 4).alias("q1"))


@query(
    "p99_latency",
    f"""WITH {EV}, newest AS (SELECT (arr - us) / 1000.0 AS ms FROM ev
  ORDER BY arr DESC, part DESC, off DESC LIMIT 1000),
ranked AS (SELECT ms, row_number() OVER (ORDER BY ms) AS rn, count(*) OVER () AS n FROM newest)
SELECT n AS n_samples, CAST(ms AS DOUBLE) AS p99 FROM ranked
WHERE rn = least(CAST(floor(n * 0.99) AS BIGINT) + 1, n)""",
)
def p99_latency(spark, sf_dir):
    facts = data.facts(spark, sf_dir)
    late = (F.unix_micros("ingest_time") - F.unix_micros("event_time")) / 1000.0
    return metrics.p99(facts.withColumn("ms", late), "ms", ["ingest_time", "partition", "offset"])


@query(
    "run_counters",
    f"""WITH {REPLAY}
SELECT count(*) FILTER (decision = 'accept') AS events_processed,
       count(*) FILTER (decision = 'drop') AS events_dropped,
       {snap_sql('count(*) / ((max(arr) - min(arr)) / 1e6)', 8)} AS throughput,
       {snap_sql("max_by(greatest((arr - wm) / 1e6, 0.0), arr)", 6)} AS watermark_lag,
       (SELECT count(*) FROM v0 WHERE s + {HOURLY.size} > (SELECT max(wm) FROM wm)) AS active_windows
FROM wm""",
)
def run_counters(spark, sf_dir):
    row = metrics.counters(data.window_replay(spark, sf_dir))
    return row.select(
        "events_processed",
        "events_dropped",
        snap("throughput", 8).alias("throughput"),
        snap("watermark_lag", 6).alias("watermark_lag"),
        "active_windows",
    )


@query(
    "event_density",
    f"""WITH {EV}, origin AS (SELECT epoch_us(TIMESTAMP '2024-01-30 23:30:00') AS o),
points AS (SELECT unnest(generate_series(0, 59)) AS point)
SELECT CAST(point AS INTEGER) AS point, o + point * 30000000 AS span_us, count(ev.us) AS n_events
FROM points CROSS JOIN origin LEFT JOIN ev
  ON ev.us >= o + point * 30000000 AND ev.us < o + (point + 1) * 30000000
GROUP BY point, o""",
)
def event_density(spark, sf_dir):
    rows = metrics.event_density(data.facts(spark, sf_dir), END)
    return rows.select("point", F.unix_micros("span_start").alias("span_us"), "n_events")


@query(
    "event_density_monthly",
    f"""WITH {EV}, origin AS (SELECT epoch_us(TIMESTAMP '2024-01-01') AS o),
points AS (SELECT unnest(generate_series(0, 719)) AS point)
SELECT CAST(point AS INTEGER) AS point, o + point * 3600000000 AS span_us, count(ev.us) AS n_events
FROM points CROSS JOIN origin LEFT JOIN ev
  ON ev.us >= o + point * 3600000000 AND ev.us < o + (point + 1) * 3600000000
GROUP BY point, o""",
)
def event_density_monthly(spark, sf_dir):
    rows = metrics.event_density(data.facts(spark, sf_dir), END, points=720, every_seconds=3600)
    return rows.select("point", F.unix_micros("span_start").alias("span_us"), "n_events")


@query(
    "health_bands",
    f"""WITH {WM}, m AS (SELECT greatest((arr - wm) / 1e6, 0.0) AS lag, (arr - us) / 1000.0 / 1000.0 AS lat
  FROM wm), b AS (
  SELECT 'lag' AS measure, CASE WHEN lag / 300 < 2 THEN 'green' WHEN lag / 300 < 5 THEN 'amber'
         ELSE 'red' END AS band FROM m UNION ALL
  SELECT 'latency', CASE WHEN lat < 50 THEN 'green' WHEN lat < 200 THEN 'amber' ELSE 'red' END FROM m)
SELECT measure, band, count(*) AS n_rows FROM b GROUP BY measure, band""",
)
def health_bands(spark, sf_dir):
    # The derived arrivals lag by minutes, so both measures are scaled to make every band occur.
    rows = watermark.with_lag(data.replayed(spark, sf_dir)).select(
        (F.col("lag_seconds") / 300).alias("lag_seconds"),
        ((F.unix_micros("ingest_time") - F.unix_micros("event_time")) / 1000.0 / 1000.0).alias(
            "latency_ms"
        ),
    )
    return metrics.health_bands(rows)


SPAN = 600 * SECOND


@query(
    "recent_series",
    f"""WITH {EV}, c AS (SELECT arr // {SPAN} * {SPAN} AS span, count(*) AS n FROM ev GROUP BY 1),
spine AS (SELECT unnest(generate_series(min(span), max(span), {SPAN})) AS span FROM c),
d AS (SELECT span, coalesce(n, 0) / 600.0 AS r FROM spine LEFT JOIN c USING (span)),
t AS (SELECT span, r, least(min(r) OVER w, 0.0) AS low, greatest(max(r) OVER w, 1.0) AS high FROM d
  WINDOW w AS (ORDER BY span ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT span AS span_us, {snap_sql('r', 8)} AS events_per_second, {snap_sql('low', 8)} AS low,
       {snap_sql('high', 8)} AS high, {snap_sql('(r - low) / (high - low)', 8)} AS scaled FROM t""",
)
def recent_series(spark, sf_dir):
    rows = metrics.recent_series(data.facts(spark, sf_dir), every_seconds=600)
    return rows.select(
        F.unix_micros("span_start").alias("span_us"),
        *[snap(c, 8).alias(c) for c in ("events_per_second", "low", "high", "scaled")],
    )
