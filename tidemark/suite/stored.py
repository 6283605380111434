"""Queries on the stored tables, written to scratch from the supplied data and read back."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.operators import enrich, readonly_sql
from tidemark.plans.durable import scratch_path
from tidemark.sources.store import (
    Store,
    expanded,
    metrics_of,
    windows_at_many,
)
from tidemark.suite import data
from tidemark.suite.data import DIM, HOURLY, REPLAY, window_id_sql
from tidemark.suite.registry import ORACLES, once, query, snap, snap_sql

CUTOFF = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)
INSTANT = datetime(2024, 1, 15, 9, 40, tzinfo=timezone.utc)
ID = window_id_sql(HOURLY)
SIZE = HOURLY.size


def fill(spark, sf_dir: str) -> Store:
    """A store with every enriched event and every window result of the replay."""
    target = Store(spark, scratch_path(spark, "store"))
    types = data.attribute_types(spark, sf_dir)
    joined = enrich.enrich(data.facts(spark, sf_dir), data.dimension_table(spark, sf_dir), types)
    target.add_events(joined, 0)
    target.add_windows(data.window_replay(spark, sf_dir).results(), 0)
    return target


@once
def store(spark, sf_dir: str) -> Store:
    return fill(spark, sf_dir)


# Version 0 with its closing arrival, then the corrections.
RESULTS = f"""{REPLAY},
results AS (
  SELECT s, 0 AS version, n, value_sum, (SELECT min(arr) FROM wm WHERE wm.wm >= closed.s + {SIZE}) AS emitted
  FROM closed
  UNION ALL SELECT s, version, n, value_sum, arr FROM corr)"""


@query(
    "tables_init",
    f"""WITH {RESULTS} SELECT 'joined_events' AS table_name, 0 AS n_rows, 'empty' AS state
UNION ALL SELECT 'window_results', 0, 'empty'
UNION ALL SELECT 'joined_events', count(*), 'filled' FROM ev
UNION ALL SELECT 'window_results', count(*), 'filled' FROM results""",
)
def tables_init(spark, sf_dir):
    """Row counts of a store nobody wrote to and of the filled one."""
    empty = Store(spark, scratch_path(spark, "empty"))
    full = store(spark, sf_dir)
    counts = empty.stats().withColumn("state", F.lit("empty"))
    return counts.unionByName(full.stats().withColumn("state", F.lit("filled")))


@query(
    "joined_sink",
    f"""WITH {DIM}, {data.EV}
SELECT CAST(event_id AS VARCHAR) AS event_id, us AS event_time_us, arr AS ingest_time_us,
       CAST(user_id AS VARCHAR) AS join_key, '{data.TOPIC}' AS source_topic, part AS partition_id,
       off AS offset_id, name, order_key, 6 AS n_attributes
FROM ev LEFT JOIN dim ON dim.key = CAST(user_id AS VARCHAR) AND dim.is_active""",
)
def joined_sink(spark, sf_dir):
    attribute = lambda name: F.get_json_object("dimension_attrs_json", f"$.{name}")
    return store(spark, sf_dir).joined_events().select(
        "event_id",
        F.unix_micros("event_time").alias("event_time_us"),
        F.unix_micros("ingest_time").alias("ingest_time_us"),
        "join_key",
        "source_topic",
        "partition_id",
        "offset_id",
        attribute("name").alias("name"),
        attribute("order_key").cast("bigint").alias("order_key"),
        F.size(F.json_object_keys("dimension_attrs_json")).alias("n_attributes"),
    )


@query(
    "window_upsert",
    f"""WITH {REPLAY}, r AS (
  SELECT s, 0 AS version, n + 100 AS n FROM closed UNION ALL SELECT s, version, n FROM corr)
SELECT {ID} AS window_id, CAST(version AS INTEGER) AS correction_version,
       CAST(n AS INTEGER) AS event_count, version > 0 AS is_correction FROM r""",
)
def window_upsert(spark, sf_dir):
    """Version 0 of every window is written again with 100 more events, then the table is folded."""
    target = Store(spark, scratch_path(spark, "upsert"))
    results = store(spark, sf_dir).window_results()
    target.add_windows(results, 0)
    again = results.filter("correction_version = 0").withColumn(
        "event_count", F.col("event_count") + 100
    )
    target.add_windows(again, 1)
    target.compact_windows()
    return target.window_results().select(
        "window_id", "correction_version", "event_count", "is_correction"
    )


@query(
    "retention",
    f"""WITH {RESULTS}, c AS (SELECT epoch_us(TIMESTAMP '2024-01-20 12:00:00') AS cut),
e AS (SELECT us // 86400000000 AS day, us < cut AS old FROM ev, c),
w AS (SELECT s // 86400000000 AS day, s + {SIZE} < cut AS old FROM results, c),
gone AS (SELECT (SELECT count(*) FROM e WHERE old) + (SELECT count(*) FROM w WHERE old) AS deleted)
SELECT 'joined_events' AS table_name, day, count(*) AS n_rows, deleted FROM e, gone
WHERE NOT old GROUP BY day, deleted
UNION ALL SELECT 'window_results', day, count(*), deleted FROM w, gone WHERE NOT old GROUP BY day, deleted""",
)
def retention(spark, sf_dir):
    target = fill(spark, sf_dir)
    deleted = target.drop_before(CUTOFF)
    kept = [
        rows.groupBy(F.expr(f"unix_micros({column}) div 86400000000").alias("day"))
        .agg(F.count("*").alias("n_rows"))
        .select(F.lit(name).alias("table_name"), "day", "n_rows")
        for name, rows, column in (
            ("joined_events", target.joined_events(), "event_time"),
            ("window_results", target.window_results(), "window_start"),
        )
    ]
    return kept[0].unionByName(kept[1]).withColumn("deleted", F.lit(deleted).cast("bigint"))


@query(
    "table_stats",
    f"""WITH {RESULTS} SELECT 'joined_events' AS table_name, count(*) AS n_rows FROM ev
UNION ALL SELECT 'window_results', count(*) FROM results""",
)
def table_stats(spark, sf_dir):
    return store(spark, sf_dir).stats()


@query(
    "latest_windows",
    f"""WITH {RESULTS}, named AS (SELECT {ID} AS window_id, * FROM results)
SELECT window_id, CAST(version AS INTEGER) AS correction_version, CAST(n AS INTEGER) AS event_count,
       emitted AS emitted_us FROM named ORDER BY emitted DESC, window_id, version LIMIT 100""",
)
def latest_windows(spark, sf_dir):
    return store(spark, sf_dir).latest_windows().select(
        "window_id",
        "correction_version",
        "event_count",
        F.unix_micros("emitted_at").alias("emitted_us"),
    )


@query(
    "windows_at_time",
    f"""WITH {RESULTS}, t AS (SELECT epoch_us(TIMESTAMP '2024-01-15 09:40:00') AS t),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY version DESC) AS rn FROM results, t
  WHERE s <= t AND s + {SIZE} > t)
SELECT {ID} AS window_id, CAST(version AS INTEGER) AS correction_version,
       CAST(n AS INTEGER) AS event_count FROM r WHERE rn = 1""",
)
def windows_at_time(spark, sf_dir):
    return store(spark, sf_dir).windows_at(INSTANT, HOURLY.size_seconds).select(
        "window_id", "correction_version", "event_count"
    )


@query("sql_table_function", ORACLES["windows_at_time"])
def sql_table_function(spark, sf_dir):
    """The same through the SQL gate, from a table function over the registered tables."""
    store(spark, sf_dir).register()
    return readonly_sql.run(
        spark,
        f"""SELECT window_id, correction_version, event_count
FROM windows_at(TIMESTAMP '{INSTANT:%Y-%m-%d %H:%M:%S}')""",
    )


@query(
    "windows_at_many_times",
    f"""WITH {RESULTS}, top AS (SELECT s, max(version) AS v, max(n) AS n FROM results GROUP BY s)
SELECT CAST(event_id AS VARCHAR) AS event_id, {ID} AS window_id,
       CAST(top.v AS INTEGER) AS correction_version, CAST(top.n AS INTEGER) AS event_count
FROM ev JOIN top ON s <= us AND s + {SIZE} > us""",
)
def windows_at_many_times(spark, sf_dir):
    instants = data.facts(spark, sf_dir).select("event_id", F.col("event_time").alias("instant"))
    rows = windows_at_many(store(spark, sf_dir).window_results(), instants, HOURLY)
    return rows.select("event_id", "window_id", "correction_version", "event_count")


@query(
    "windows_expanded",
    f"""WITH {RESULTS}, named AS (SELECT {ID} AS window_id, * FROM results)
SELECT window_id, CAST(version AS INTEGER) AS correction_version, 'count' AS metric,
       CAST(n AS DOUBLE) AS metric_value FROM named
UNION ALL SELECT window_id, CAST(version AS INTEGER), 'value_sum', {snap_sql('value_sum', 2)} FROM named""",
)
def windows_expanded(spark, sf_dir):
    rows = metrics_of(store(spark, sf_dir).window_results())
    return rows.filter(F.col("metric").isin("count", "value_sum")).select(
        "window_id", "correction_version", "metric", snap("metric_value", 2).alias("metric_value")
    )


@query(
    "limited_result",
    f"""WITH {RESULTS}, named AS (SELECT {ID} AS window_id, * FROM results),
o AS (SELECT window_id, CAST(version AS INTEGER) AS correction_version, CAST(n AS INTEGER) AS event_count,
      count(*) OVER () AS total_available FROM named)
SELECT *, total_available > 50 AS truncated FROM o
ORDER BY event_count DESC, window_id, correction_version LIMIT 50""",
)
def limited_result(spark, sf_dir):
    rows = expanded(store(spark, sf_dir).window_results()).select(
        "window_id", "correction_version", "event_count"
    )
    ordered = rows.orderBy(F.desc("event_count"), "window_id", "correction_version")
    return readonly_sql.limited(ordered, 50)


SOUGHT = ["17", "4242", "9001", "no-such-id"]


@query(
    "lookup_by_id",
    f"""WITH {data.EV} SELECT CAST(event_id AS VARCHAR) AS event_id, us AS event_time_us,
       CAST(user_id AS VARCHAR) AS join_key FROM ev WHERE CAST(event_id AS VARCHAR) IN ({', '.join(repr(x) for x in SOUGHT)})""",
)
def lookup_by_id(spark, sf_dir):
    """Events by id alone, without a date: found through the Bloom filters of the stored files."""
    rows = store(spark, sf_dir).events_by("event_id", SOUGHT)
    return rows.select("event_id", F.unix_micros("event_time").alias("event_time_us"), "join_key")


@query(
    "lookup_events",
    f"""WITH {data.EV} SELECT CAST(event_id AS VARCHAR) AS event_id, us AS event_time_us FROM ev
WHERE us >= epoch_us(TIMESTAMP '2024-01-10 06:00:00') AND us < epoch_us(TIMESTAMP '2024-01-12 18:00:00')""",
)
def lookup_events(spark, sf_dir):
    rows = store(spark, sf_dir).events_between(
        datetime(2024, 1, 10, 6, tzinfo=timezone.utc), datetime(2024, 1, 12, 18, tzinfo=timezone.utc)
    )
    return rows.select("event_id", F.unix_micros("event_time").alias("event_time_us"))


def _views(spark, sf_dir: str) -> None:
    store(spark, sf_dir).register()


@query(
    "sql_readonly",
    f"""WITH {RESULTS} SELECT CAST(version AS INTEGER) AS correction_version, count(*) AS n_windows,
       CAST(sum(n) AS BIGINT) AS n_events FROM results GROUP BY version""",
)
def sql_readonly(spark, sf_dir):
    _views(spark, sf_dir)
    return readonly_sql.run(
        spark,
        """-- windows by version
        SELECT correction_version, count(*) AS n_windows, sum(event_count) AS n_events
        FROM window_results GROUP BY correction_version""",
    )


@query(
    "sql_params",
    f"""WITH {data.EV} SELECT CAST(user_id AS VARCHAR) AS join_key, count(*) AS n_events, 42 AS val
FROM ev WHERE us >= epoch_us(TIMESTAMP '2024-01-15') GROUP BY user_id""",
)
def sql_params(spark, sf_dir):
    _views(spark, sf_dir)
    return readonly_sql.run(
        spark,
        "SELECT join_key, count(*) AS n_events, ? AS val FROM joined_events "
        "WHERE event_time >= ? GROUP BY join_key",
        [42, datetime(2024, 1, 15, tzinfo=timezone.utc)],
    )
