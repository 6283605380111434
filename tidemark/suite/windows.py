"""Queries on window assignment, aggregates, closing and late corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.functions.rules import violation_counts
from tidemark.functions.times import Windows, window_bounds
from tidemark.operators import sketches
from tidemark.operators import windows as w
from tidemark.operators.corrections import latest
from tidemark.sources.store import metrics_of
from tidemark.operators.validation import window_rules
from tidemark.suite import data
from tidemark.suite.data import EV, FIELDS, FIVE_MINUTES, HOURLY, REPLAY, spread_sql, window_id_sql
from tidemark.suite.registry import query, snap, snap_sql
from tidemark.suite.stored import store

SIZE = HOURLY.size
ID = window_id_sql(HOURLY)

MEASURES = f"""count(*) AS event_count, {snap_sql('sum(value)', 2)} AS value_sum,
       min(value) AS value_min, max(value) AS value_max, {snap_sql('avg(value)', 6)} AS value_avg,
       CAST(sum(k) AS DOUBLE) AS k_sum"""


def _measures():
    return [
        "event_count",
        snap("value_sum", 2).alias("value_sum"),
        "value_min",
        "value_max",
        snap("value_avg", 6).alias("value_avg"),
        "k_sum",
    ]


@query(
    "window_assign",
    f"""WITH {EV} SELECT event_id, {ID} AS window_id, s AS window_start_us, s + {SIZE} AS window_end_us
FROM {spread_sql('ev', HOURLY)}""",
)
def window_assign(spark, sf_dir):
    rows = w.assign(data.events(spark, sf_dir).select("event_id", "event_time"), HOURLY)
    return rows.select(
        "event_id",
        "window_id",
        F.unix_micros("window_start").alias("window_start_us"),
        F.unix_micros("window_end").alias("window_end_us"),
    )


UNEVEN = Windows(1000, 400)


@query(
    "window_assign_uneven",
    f"""WITH {EV} SELECT {window_id_sql(UNEVEN)} AS window_id, count(*) AS event_count,
       {snap_sql('sum(value)', 2)} AS value_sum
FROM {spread_sql('ev', UNEVEN)} GROUP BY s""",
)
def window_assign_uneven(spark, sf_dir):
    rows = w.aggregate(data.events(spark, sf_dir), UNEVEN, ["value"])
    return rows.select("window_id", "event_count", snap("value_sum", 2).alias("value_sum"))


@query(
    "tumbling_agg",
    f"""WITH {EV} SELECT {window_id_sql(FIVE_MINUTES)} AS window_id, {MEASURES}
FROM {spread_sql('ev', FIVE_MINUTES)} GROUP BY s""",
)
def tumbling_agg(spark, sf_dir):
    rows = w.aggregate(data.measured_facts(spark, sf_dir), FIVE_MINUTES, FIELDS)
    return rows.select("window_id", *_measures())


@query(
    "sliding_agg",
    f"WITH {EV} SELECT {ID} AS window_id, {MEASURES} FROM {spread_sql('ev', HOURLY)} GROUP BY s",
)
def sliding_agg(spark, sf_dir):
    rows = w.aggregate(data.measured_facts(spark, sf_dir), HOURLY, FIELDS)
    return rows.select("window_id", *_measures())


DEFAULT = Windows()


@query(
    "sliding_agg_default",
    f"""WITH {EV}, g AS (SELECT s, count(*) AS n, sum(value) AS v, min(value) AS lo, max(value) AS hi
  FROM {spread_sql('ev', DEFAULT)} GROUP BY s)
SELECT s // 3600000000 AS hour, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS event_count,
       {snap_sql('sum(v)', 2)} AS value_sum, min(lo) AS value_min, max(hi) AS value_max,
       max(n) AS busiest FROM g GROUP BY 1""",
)
def sliding_agg_default(spark, sf_dir):
    """Windows of 300 s every second, summed up by the hour they start in."""
    rows = w.aggregate(data.events(spark, sf_dir), DEFAULT, ["value"])
    hour = F.expr("unix_micros(window_start) div 3600000000")
    return rows.groupBy(hour.alias("hour")).agg(
        F.count("*").alias("n_windows"),
        F.sum("event_count").alias("event_count"),
        snap(F.sum("value_sum"), 2).alias("value_sum"),
        F.min("value_min").alias("value_min"),
        F.max("value_max").alias("value_max"),
        F.max("event_count").alias("busiest"),
    )


@query(
    "sliding_agg_by_key",
    f"""WITH {EV} SELECT event_type, {ID} AS window_id, {MEASURES}
FROM {spread_sql('ev', HOURLY)} GROUP BY event_type, s""",
)
def sliding_agg_by_key(spark, sf_dir):
    rows = w.aggregate(data.events(spark, sf_dir), HOURLY, FIELDS, ["event_type"])
    return rows.select("event_type", "window_id", *_measures())


def _single(name: str, column: str, sql: str, digits: int | None = None):
    """A query for one aggregate: only the purchases carry ``amount``, the others lack the field."""

    @query(
        name,
        f"""WITH {EV}, a AS (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS amount FROM ev)
SELECT {ID} AS window_id, {snap_sql(sql, digits) if digits else sql} AS {column}
FROM {spread_sql('a', HOURLY)} GROUP BY s""",
    )
    def build(spark, sf_dir):
        amount = F.when(F.col("event_type") == "purchase", F.col("value"))
        rows = data.events(spark, sf_dir).withColumn("amount", amount)
        shown = snap(column, digits).alias(column) if digits else F.col(column)
        return w.aggregate(rows, HOURLY, ["amount"]).select("window_id", shown)

    return build


agg_count = _single("agg_count", "event_count", "count(*)")
agg_sum = _single("agg_sum", "amount_sum", "sum(amount)", 2)
agg_min = _single("agg_min", "amount_min", "min(amount)")
agg_max = _single("agg_max", "amount_max", "max(amount)")
agg_avg = _single("agg_avg", "amount_avg", "avg(amount)", 6)


@query(
    "agg_by_field",
    f"""WITH {EV}, g AS (SELECT s, count(*) AS n, sum(value) AS vs, min(value) AS vl,
  max(value) AS vh, avg(value) AS va, sum(k) AS ks, min(k) AS kl, max(k) AS kh, avg(k) AS ka
  FROM {spread_sql('ev', HOURLY)} GROUP BY s)
SELECT {ID} AS window_id, unnest(['count', 'value_sum', 'value_min', 'value_max', 'value_avg',
         'k_sum', 'k_min', 'k_max', 'k_avg']) AS metric,
       {snap_sql('unnest([CAST(n AS DOUBLE), vs, vl, vh, va, ks, kl, kh, ka])', 6)} AS metric_value
FROM g""",
)
def agg_by_field(spark, sf_dir):
    facts = data.facts(spark, sf_dir)
    values = payload.numeric_fields(facts, ["event_time"])
    rows = w.aggregate_fields(facts, values, HOURLY)
    return rows.select("window_id", F.explode("aggregations").alias("metric", "_value")).select(
        "window_id", "metric", snap("_value", 6).alias("metric_value")
    )


# Each event with the fields of a payload of its own: one that all have, and one of five names.
FOUND = f"""{REPLAY},
late_versions AS (SELECT s, arr, part, off, version FROM corr),
numbers AS (
  SELECT wm.*, field, x FROM wm, LATERAL (
    VALUES ('value', CAST(value AS DOUBLE)), ('kind_' || event_id % 5, CAST(k AS DOUBLE))) AS t(field, x)),
numbers_spread AS (SELECT * FROM {spread_sql('numbers', HOURLY)}),
hits AS (
  SELECT s, 0 AS version, field, sum(x) AS sx, min(x) AS lo, max(x) AS hi FROM numbers_spread
  WHERE decision = 'accept' AND s + {SIZE} > wm AND s IN (SELECT s FROM closed) GROUP BY s, field
  UNION ALL
  SELECT n.s, version, field, x, x, x FROM numbers_spread n JOIN late_versions USING (s, arr, part, off)),
all_versions AS (SELECT s, 0 AS version FROM closed UNION ALL SELECT s, version FROM corr),
found AS (
  SELECT a.s, a.version, field, sum(sx) AS sum, min(lo) AS min, max(hi) AS max
  FROM all_versions a JOIN hits h ON h.s = a.s AND h.version <= a.version GROUP BY a.s, a.version, field)"""


@query(
    "window_found_fields",
    f"""WITH {FOUND}, long AS (
  SELECT s, version, field, unnest(['sum', 'min', 'max']) AS part, unnest([sum, min, max]) AS x FROM found)
SELECT {ID} AS window_id, CAST(version AS INTEGER) AS correction_version, field || '_' || part AS metric,
       {snap_sql('x', 2)} AS metric_value FROM long""",
)
def window_found_fields(spark, sf_dir):
    """All versions of all closed windows with the fields found in the payloads, none of them listed."""
    results = data.found_fields_replay(spark, sf_dir).results()
    rows = metrics_of(results).filter("metric <> 'count' and not endswith(metric, '_avg')")
    return rows.select(
        "window_id", "correction_version", "metric", snap("metric_value", 2).alias("metric_value")
    )


# Distinct users of each window from sketches of its panes: within 5 % of the exact count, or two.
@query(
    "window_distinct",
    f"""WITH {EV} SELECT {ID} AS window_id, count(DISTINCT user_id) AS n_users, true AS within_bounds
FROM {spread_sql('ev', HOURLY)} GROUP BY s""",
)
def window_distinct(spark, sf_dir):
    """On-time events and late ones are sketched apart and merged, as corrections are."""
    events = data.events(spark, sf_dir)
    late = F.col("event_id") % 10 == 0
    keys = ["_pane"]
    parts = [sketches.pane_sketches(events.filter(part), HOURLY, "user_id") for part in (~late, late)]
    panes = sketches.merged(parts[0].unionByName(parts[1]), keys)
    found = sketches.estimated(sketches.window_sketches(panes, HOURLY), "estimate")
    exact = w.assign(events, HOURLY).groupBy("window_id").agg(F.count_distinct("user_id").alias("n_users"))
    told = found.select(HOURLY.bounds("_start")[0], "estimate").join(exact, "window_id")
    bound = F.greatest(F.col("n_users") * 0.05, F.lit(2.0))
    return told.select(
        "window_id", "n_users", (F.abs(F.col("estimate") - F.col("n_users")) <= bound).alias("within_bounds")
    )


SHOW_V0 = f"""{ID} AS window_id, n AS event_count, {snap_sql('value_sum', 2)} AS value_sum,
       value_min, value_max, {snap_sql('value_sum / n', 6)} AS value_avg,
       CAST(k_sum AS DOUBLE) AS k_sum"""


@query("window_close", f"WITH {REPLAY} SELECT {SHOW_V0} FROM closed")
def window_close(spark, sf_dir):
    return data.window_replay(spark, sf_dir).closed().select("window_id", *_measures())


@query(
    "window_partial",
    f"""WITH {REPLAY} SELECT {SHOW_V0}, true AS is_partial FROM v0
WHERE s + {SIZE} > (SELECT max(wm) FROM wm)""",
)
def window_partial(spark, sf_dir):
    return data.window_replay(spark, sf_dir).open().select("window_id", *_measures(), "is_partial")


@query(
    "active_windows",
    f"WITH {REPLAY} SELECT {ID} AS window_id FROM v0 WHERE s + {SIZE} > (SELECT max(wm) FROM wm)",
)
def active_windows(spark, sf_dir):
    return data.window_replay(spark, sf_dir).open().select("window_id")


@query(
    "late_correction",
    f"""WITH {REPLAY} SELECT {ID} AS window_id, CAST(version AS INTEGER) AS correction_version,
       arr AS emitted_us, n AS event_count, {snap_sql('value_sum', 2)} AS value_sum, value_min,
       value_max, {snap_sql('value_sum / n', 6)} AS value_avg, CAST(k_sum AS DOUBLE) AS k_sum
FROM corr""",
)
def late_correction(spark, sf_dir):
    rows = data.window_replay(spark, sf_dir).corrections()
    return rows.select(
        "window_id",
        "correction_version",
        F.unix_micros("emitted_at").alias("emitted_us"),
        *_measures(),
    )


@query(
    "late_correction_newest",
    f"""WITH {REPLAY}, newest AS (
  SELECT *, max(s) OVER (PARTITION BY event_id) AS top FROM late)
SELECT {ID} AS window_id, CAST(row_number() OVER w AS INTEGER) AS correction_version,
       n0 + count(*) OVER w AS event_count, {snap_sql('value0 + sum(value) OVER w', 2)} AS value_sum
FROM newest WHERE s = top
WINDOW w AS (PARTITION BY s ORDER BY arr, part, off ROWS UNBOUNDED PRECEDING)""",
)
def late_correction_newest(spark, sf_dir):
    rows = data.window_replay(spark, sf_dir).corrections("newest")
    return rows.select(
        "window_id", "correction_version", "event_count", snap("value_sum", 2).alias("value_sum")
    )


@query(
    "correction_pairs",
    f"""WITH {REPLAY} SELECT {ID} AS window_id, CAST(version AS INTEGER) AS correction_version,
       coalesce(lag(n) OVER w, n0) AS previous_count, n AS event_count,
       {snap_sql('coalesce(lag(value_sum) OVER w, value0)', 2)} AS previous_sum,
       {snap_sql('value_sum', 2)} AS value_sum
FROM corr WINDOW w AS (PARTITION BY s ORDER BY version)""",
)
def correction_pairs(spark, sf_dir):
    rows = data.window_replay(spark, sf_dir).corrections()
    return rows.select(
        "window_id",
        "correction_version",
        F.col("previous.event_count").alias("previous_count"),
        "event_count",
        snap("previous.value_sum", 2).alias("previous_sum"),
        snap("value_sum", 2).alias("value_sum"),
    )


@query(
    "window_id",
    f"""WITH {EV}, d AS (SELECT DISTINCT s FROM {spread_sql('ev', HOURLY)})
SELECT {ID} AS window_id, s AS start_us, s + {SIZE} AS end_us FROM d""",
)
def window_id(spark, sf_dir):
    ids = w.aggregate(data.events(spark, sf_dir), HOURLY, []).select("window_id")
    bounds = ids.select("window_id", *window_bounds(F.col("window_id")))
    return bounds.select(
        "window_id",
        F.unix_micros("window_start").alias("start_us"),
        F.unix_micros("window_end").alias("end_us"),
    )


@query(
    "aggregations_json",
    f"""WITH {EV}, g AS (SELECT s, count(*) AS n, sum(k) AS ks, min(k) AS kl, max(k) AS kh
  FROM {spread_sql('ev', HOURLY)} GROUP BY s)
SELECT {ID} AS window_id, CAST(n AS DOUBLE) AS n, CAST(ks AS DOUBLE) AS k_sum,
       CAST(kl AS DOUBLE) AS k_min, CAST(kh AS DOUBLE) AS k_max, 5 AS n_metrics FROM g""",
)
def aggregations_json(spark, sf_dir):
    rows = w.aggregate(data.events(spark, sf_dir), HOURLY, ["k"])
    packed = rows.select("window_id", w.packed(w.aggregations(["k"])).alias("aggregations_json"))
    found = packed.withColumn("m", w.unpacked("aggregations_json"))
    return found.select(
        "window_id",
        F.col("m")["count"].alias("n"),
        F.col("m")["k_sum"].alias("k_sum"),
        F.col("m")["k_min"].alias("k_min"),
        F.col("m")["k_max"].alias("k_max"),
        F.size("m").alias("n_metrics"),
    )


@query(
    "valid_windows",
    f"""WITH {REPLAY} SELECT CASE WHEN version = 2 THEN 'closed_without_emission'
       WHEN version = 3 THEN 'start_not_before_end' WHEN version = 4 THEN 'negative_event_count'
       ELSE 'valid' END AS outcome, count(*) AS n_rows FROM corr GROUP BY outcome""",
)
def valid_windows(spark, sf_dir):
    version = F.col("correction_version")
    states = data.window_replay(spark, sf_dir).corrections().select(
        F.when(version == 3, F.col("window_end")).otherwise(F.col("window_start")).alias("window_start"),
        "window_end",
        F.when(version == 4, -1).otherwise(F.col("event_count")).alias("event_count"),
        version.alias("correction_count"),
        F.lit(True).alias("is_closed"),
        F.when(version != 2, F.col("emitted_at")).alias("last_emitted_at"),
    )
    return violation_counts(states, window_rules())


@query(
    "latest_correction",
    f"""WITH {REPLAY}, top AS (SELECT s, max(version) AS v, max(n) AS n FROM corr GROUP BY s)
SELECT {ID} AS window_id, CAST(coalesce(top.v, 0) AS INTEGER) AS correction_version,
       CAST(coalesce(top.n, closed.n) AS INTEGER) AS event_count
FROM closed LEFT JOIN top USING (s)""",
)
def latest_correction(spark, sf_dir):
    rows = latest(store(spark, sf_dir).window_results())
    return rows.select("window_id", "correction_version", "event_count")
