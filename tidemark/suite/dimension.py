"""Queries on the dimension table and on enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import violation_counts
from tidemark.operators import dimension, enrich
from tidemark.operators.validation import dimension_rules
from tidemark.plans.durable import written
from tidemark.schemas import ARRIVAL_ORDER
from tidemark.suite import data
from tidemark.suite.data import CHANGES, DIM, EV, LOADED_AT
from tidemark.suite.registry import query

def _shown(table: DataFrame) -> DataFrame:
    """Dimension rows with their attributes as plain columns."""
    types = {"name": "string", "order_key": "bigint", "price": "double"}
    timed = table.withColumn("updated_us", F.unix_micros("updated_at"))
    return enrich.flatten_attributes(
        timed, types, ["dimension_key", "version", "updated_us", "is_active"]
    )


SHOWN = """key AS dimension_key, version, epoch_us(updated_at) AS updated_us, name, order_key, price"""


@query(
    "dim_load",
    """SELECT CAST(o_custkey AS VARCHAR) AS dimension_key, max(version) AS version,
       max_by(o_orderkey, version * 1000000000 + o_orderkey) AS order_key, true AS is_active
FROM (SELECT *, CASE WHEN o_orderkey % 9 >= 1 THEN o_orderkey % 9 ELSE 1 END AS version FROM orders)
GROUP BY o_custkey""",
)
def dim_load(spark, sf_dir):
    orders = data.table(spark, sf_dir, "orders")
    records = orders.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_orderkey") % 9).alias("version"),
    )
    table = dimension.loaded(
        dimension.load_changes(records, "user_id", F.col("order_key"), F.lit(LOADED_AT))
    )
    return enrich.flatten_attributes(
        table, {"order_key": "bigint"}, ["dimension_key", "version", "is_active"]
    )


@query(
    "dim_upsert",
    f"""WITH {CHANGES}, w AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq) AS rn
  FROM chg WHERE op = 'upsert')
SELECT {SHOWN}, true AS is_active FROM w WHERE rn = 1""",
)
def dim_upsert(spark, sf_dir):
    changes = data.changes(spark, sf_dir)
    base = dimension.loaded(changes.filter("seq < 0"))
    updates = changes.filter("seq >= 0 and op = 'upsert'")
    return _shown(dimension.upsert(base, updates))


@query("dim_replay", f"WITH {DIM} SELECT {SHOWN}, is_active FROM dim")
def dim_replay(spark, sf_dir):
    return _shown(data.dimension_table(spark, sf_dir))


@query(
    "dim_delete",
    """SELECT CAST(c_custkey AS VARCHAR) AS dimension_key, c_custkey NOT IN (
  SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0) AS is_active FROM customer""",
)
def dim_delete(spark, sf_dir):
    changes = data.changes(spark, sf_dir)
    base = dimension.loaded(changes.filter("seq < 0"))
    gone = changes.filter("op = 'delete'").select("dimension_key")
    return dimension.soft_delete(base, gone).select("dimension_key", "is_active")


@query(
    "dim_lookup",
    f"""WITH {DIM}, {EV}
SELECT ev.event_id, CAST(user_id AS VARCHAR) AS dimension_key, dim.order_key
FROM ev LEFT JOIN dim ON dim.key = CAST(user_id AS VARCHAR) AND dim.is_active""",
)
def dim_lookup(spark, sf_dir):
    keys = data.events(spark, sf_dir).select(
        "event_id", F.col("user_id").cast("string").alias("dimension_key")
    )
    found = dimension.lookup(keys, data.dimension_table(spark, sf_dir))
    return found.select(
        "event_id",
        "dimension_key",
        F.get_json_object("attributes_json", "$.order_key").cast("bigint").alias("order_key"),
    )


@query("dim_snapshot", f"WITH {DIM} SELECT {SHOWN}, is_active FROM dim WHERE is_active")
def dim_snapshot(spark, sf_dir):
    return _shown(dimension.active(data.dimension_table(spark, sf_dir)))


@query("active_filter", f"WITH {DIM} SELECT key AS dimension_key, version FROM dim WHERE is_active")
def active_filter(spark, sf_dir):
    return dimension.active(data.dimension_table(spark, sf_dir)).select("dimension_key", "version")


@query("dim_row_count", f"WITH {DIM} SELECT count(DISTINCT key) AS row_count FROM dim WHERE is_active")
def dim_row_count(spark, sf_dir):
    return dimension.active_count(data.dimension_table(spark, sf_dir))


@query("dim_rebuild", f"WITH {DIM} SELECT {SHOWN}, is_active FROM dim")
def dim_rebuild(spark, sf_dir):
    stored = written(data.dimension_table(spark, sf_dir), "dimension")
    return _shown(dimension.rebuild(stored))


@query(
    "valid_dimensions",
    f"""WITH {DIM}, r AS (SELECT *, CASE WHEN version = 3 THEN '' ELSE key END AS k2,
  CASE WHEN version = 4 THEN 0 ELSE version END AS v2, version = 5 AS text_only FROM dim)
SELECT unnest(CASE WHEN k2 <> '' AND v2 >= 1 AND NOT text_only THEN ['valid'] ELSE
  list_filter([CASE WHEN k2 = '' THEN 'empty_dimension_key' END,
    CASE WHEN text_only THEN 'attributes_not_an_object' END,
    CASE WHEN v2 < 1 THEN 'version_below_one' END], lambda x: x IS NOT NULL) END) AS outcome,
  count(*) AS n_rows FROM r GROUP BY outcome""",
)
def valid_dimensions(spark, sf_dir):
    damaged = data.dimension_table(spark, sf_dir).select(
        F.when(F.col("version") == 3, "").otherwise(F.col("dimension_key")).alias("dimension_key"),
        F.when(F.col("version") == 5, '"text"')
        .otherwise(F.col("attributes_json"))
        .alias("attributes_json"),
        F.when(F.col("version") == 4, 0).otherwise(F.col("version")).alias("version"),
    )
    return violation_counts(damaged, dimension_rules())


@query(
    "attribute_keys",
    f"""WITH {DIM} SELECT DISTINCT unnest(CASE WHEN seq < 0 THEN ['balance', 'name', 'segment']
  ELSE ['order_key', 'price', 'priority'] END) AS attribute FROM dim""",
)
def attribute_keys(spark, sf_dir):
    return enrich.attribute_keys(data.dimension_table(spark, sf_dir))


@query(
    "flatten_attributes",
    """SELECT CAST(c_custkey AS VARCHAR) AS dimension_key, c_acctbal AS balance, c_name AS name,
       c_mktsegment AS segment FROM customer""",
)
def flatten_attributes(spark, sf_dir):
    """Column names and types found in the data."""
    loaded = dimension.loaded(data.changes(spark, sf_dir).filter("seq < 0"))
    return enrich.flatten_attributes(written(loaded, "dimension"))


@query(
    "flatten_mixed_attributes",
    f"WITH {DIM} SELECT key AS dimension_key, balance, name, order_key, price, priority, segment FROM dim",
)
def flatten_mixed_attributes(spark, sf_dir):
    """Rows of two kinds, each lacking the other's attributes."""
    types = data.attribute_types(spark, sf_dir)
    return enrich.flatten_attributes(data.dimension_table(spark, sf_dir), types)


JOINED = f"""WITH {DIM}, {EV}
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS join_key,
       us AS event_time_us, balance, name, order_key, price, priority, segment
FROM ev LEFT JOIN dim ON dim.key = CAST(user_id AS VARCHAR) AND dim.is_active"""


@query("stream_table_join", JOINED)
def stream_table_join(spark, sf_dir):
    table = data.dimension_table(spark, sf_dir)
    types = data.attribute_types(spark, sf_dir)
    joined = enrich.enrich(data.facts(spark, sf_dir), table, types)
    return joined.select(
        "event_id", "join_key", F.unix_micros("event_time").alias("event_time_us"), *types
    )


@query(
    "enrich_latest",
    f"""WITH {DIM}, {EV}
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS join_key, order_key,
       CASE WHEN dim.key IS NULL THEN NULL WHEN dim.seq < 0 THEN ev.value ELSE dim.price END AS price,
       CASE WHEN dim.seq < 0 THEN CAST(ev.k AS DOUBLE) END AS priority, balance
FROM ev LEFT JOIN dim ON dim.key = CAST(user_id AS VARCHAR) AND dim.is_active""",
)
def enrich_latest(spark, sf_dir):
    facts = data.measured_facts(spark, sf_dir).withColumnRenamed("value", "price")
    table = data.dimension_table(spark, sf_dir)
    # A text attribute named like a numeric fact column: its value cannot be taken over.
    facts = facts.withColumn("priority", F.col("k"))
    types = data.attribute_types(spark, sf_dir)
    joined = enrich.enrich(facts, table, types, on_conflict="override")
    return joined.select("event_id", "join_key", "order_key", "price", "priority", "balance")


@query(
    "enrich_as_of",
    f"""WITH {CHANGES}, {EV},
eff AS (
  SELECT key, op, version, seq, order_key, name FROM (
    SELECT *, max(CASE WHEN op = 'upsert' THEN version END) OVER (
      PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
    FROM chg)
  WHERE op = 'delete' OR top IS NULL OR version > top)
SELECT CAST(ev.event_id AS VARCHAR) AS event_id,
       CASE WHEN eff.op = 'upsert' THEN eff.version END AS version,
       CASE WHEN eff.op = 'upsert' THEN eff.order_key END AS order_key,
       CASE WHEN eff.op = 'upsert' THEN eff.name END AS name
FROM ev ASOF LEFT JOIN eff ON CAST(ev.user_id AS VARCHAR) = eff.key AND ev.event_id >= eff.seq""",
)
def enrich_as_of(spark, sf_dir):
    # Only what the result and the order need travels through the ordered ranges.
    facts = data.facts(spark, sf_dir).select("event_id", "join_key", *ARRIVAL_ORDER)
    position = F.col("offset") * 3 + F.col("partition")
    joined = enrich.enrich_as_of(facts, data.changes(spark, sf_dir), F.col("seq"), position)
    return joined.select(
        "event_id",
        "version",
        F.get_json_object("attributes_json", "$.order_key").cast("bigint").alias("order_key"),
        F.get_json_object("attributes_json", "$.name").alias("name"),
    )
