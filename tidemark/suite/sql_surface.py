"""Read-only SQL over the supplied tables: one statement per SQL feature.

The statements go through the same gate as any user's text. Where Spark and ANSI/DuckDB spell a
feature differently, the SQL counterpart is given next to the Spark text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import readonly_sql
from tidemark.plans.intervals import Span, covering_aggregates
from tidemark.plans.neighbours import framed, ranked, span_sums
from tidemark.plans.ordered import as_of_join
from tidemark.suite import data
from tidemark.suite.registry import query, snap, snap_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def register(spark, sf_dir: str) -> None:
    for name in TABLES:
        data.table(spark, sf_dir, name).createOrReplaceTempView(name)


def statement(name: str, text: str, ansi: str | None = None) -> None:
    @query(name, ansi or text)
    def build(spark, sf_dir):
        register(spark, sf_dir)
        return readonly_sql.run(spark, text)

    build.__doc__ = text


REVENUE = snap_sql("sum(l_extendedprice * (1 - l_discount))", 2)

statement(
    "sql_project_filter",
    f"""SELECT l_orderkey, l_linenumber, {snap_sql('l_extendedprice * (1 - l_discount)', 4)} AS net,
       CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size_class
FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'
  AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%' AND NOT (l_discount > 0.07)""",
)

statement(
    "sql_inner_join",
    f"""SELECT r_name, n_name, count(*) AS n_lines, {REVENUE} AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'
GROUP BY r_name, n_name""",
)

statement(
    "sql_outer_join",
    f"""SELECT coalesce(c.nation, s.nation) AS nation, c.n_customers, s.n_suppliers,
       o.n_orders
FROM (SELECT c_nationkey AS nation, count(*) AS n_customers FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c
FULL OUTER JOIN (SELECT s_nationkey AS nation, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s
  ON c.nation = s.nation
LEFT JOIN (SELECT c_nationkey AS nation, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) o
  ON o.nation = coalesce(c.nation, s.nation)""",
)

statement(
    "sql_semi_anti",
    """SELECT c_custkey, c_name, 'ordered' AS kind FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
UNION ALL
SELECT c_custkey, c_name, 'idle' FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL
SELECT c_custkey, c_name, 'rich nation' FROM customer
WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)""",
)

# Each order falls into exactly one band; the bands are as many as there are regions.
statement(
    "sql_theta_join",
    f"""SELECT b.band, count(*) AS n_orders, {snap_sql('sum(o_totalprice)', 2)} AS total
FROM orders JOIN (SELECT r_regionkey AS band, r_regionkey * 100000 AS low, (r_regionkey + 1) * 100000 AS high
                  FROM region) b
  ON o_totalprice >= b.low AND o_totalprice < b.high
GROUP BY b.band""",
)

statement(
    "sql_group_having",
    f"""SELECT o_custkey, o_orderpriority, count(*) AS n_orders,
       {snap_sql('sum(o_totalprice)', 2)} AS total,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished
FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) >= 3""",
)

statement(
    "sql_distinct_agg",
    """SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS n_parts,
       count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_orderkey) AS n_orders
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)


# The estimate itself differs between engines; it must be within 15 % of the exact count.
@query(
    "sql_approx_distinct",
    "SELECT l_returnflag, true AS within_bounds FROM lineitem GROUP BY l_returnflag",
)
def sql_approx_distinct(spark, sf_dir):
    """Both counts in one grouping would give every (flag, part) a sketch of its own on the way."""
    register(spark, sf_dir)
    return readonly_sql.run(
        spark,
        """SELECT a.l_returnflag, abs(a.estimate - e.exact) <= 0.15 * e.exact AS within_bounds
FROM (SELECT l_returnflag, approx_count_distinct(l_partkey, 0.02) AS estimate FROM lineitem GROUP BY l_returnflag) a
JOIN (SELECT l_returnflag, count(DISTINCT l_partkey) AS exact FROM lineitem GROUP BY l_returnflag) e
  ON a.l_returnflag <=> e.l_returnflag""",
    )


statement(
    "sql_cube_rollup",
    """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g_status,
       CAST(grouping(o_orderpriority) AS INT) AS g_priority, count(*) AS n_orders, 'cube' AS kind
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
UNION ALL
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT),
       CAST(grouping(o_orderpriority) AS INT), count(*), 'rollup'
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
UNION ALL
SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT),
       CAST(grouping(o_orderpriority) AS INT), count(*), 'sets'
FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""",
)

# The window queries partition by order: an order has a few lines, whatever the data's size.
LINE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"

statement(
    "sql_rank",
    f"""SELECT l_orderkey, l_partkey, l_extendedprice, CAST(row_number() OVER w AS INT) AS rn,
       CAST(rank() OVER p AS INT) AS rk, CAST(dense_rank() OVER p AS INT) AS dr,
       CAST(ntile(3) OVER w AS INT) AS third
FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC, {LINE}),
       p AS (PARTITION BY l_orderkey ORDER BY l_returnflag)""",
)

statement(
    "sql_lag_lead",
    f"""SELECT l_orderkey, l_partkey, l_extendedprice, lag(l_quantity) OVER w AS before,
       lead(l_quantity) OVER w AS after, first_value(l_partkey) OVER w AS first_part,
       last_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {LINE}
         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_part
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {LINE})""",
)

statement(
    "sql_frames",
    f"""SELECT l_orderkey, l_partkey, l_extendedprice,
       {snap_sql(f'sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {LINE} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)} AS last_three,
       count(*) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL '400' DAY PRECEDING AND CURRENT ROW) AS last_year
FROM lineitem""",
)

statement(
    "sql_qualify",
    f"""SELECT l_orderkey, l_partkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {LINE}) AS rn
  FROM lineitem) WHERE rn <= 2""",
    f"""SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {LINE}) <= 2""",
)

statement(
    "sql_sort_topk",
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5""",
)

statement(
    "sql_set_ops",
    """SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL
SELECT 'intersect', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL
SELECT 'intersect all', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL
SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL
SELECT 'except all', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
  EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
)

# Months from the first order to the last, so that months without orders show too.
statement(
    "sql_cte",
    """WITH RECURSIVE bounds AS (SELECT min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders),
months AS (
  SELECT CAST(0 AS INT) AS i, CAST(year(low) * 12 + month(low) - 1 AS INT) AS m,
         CAST(year(high) * 12 + month(high) - 1 AS INT) AS top FROM bounds
  UNION ALL SELECT i + 1, m + 1, top FROM months WHERE m < top),
per_month AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INT) AS m, count(*) AS n
  FROM orders GROUP BY 1)
SELECT months.m AS month_number, coalesce(n, 0) AS n_orders FROM months LEFT JOIN per_month ON months.m = per_month.m""",
)

statement(
    "sql_subquery",
    f"""SELECT o_orderkey, o_totalprice, t.n_lines,
       {snap_sql('(SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey)', 2)} AS quantity
FROM orders o, LATERAL (SELECT count(*) AS n_lines FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) t
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)""",
)

statement(
    "sql_pivot",
    f"""SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)
PIVOT (CAST(sum(l_quantity) AS DOUBLE) AS q FOR l_linestatus IN ('F' AS f, 'O' AS o))""",
    """SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS f,
       sum(l_quantity) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag""",
)

statement(
    "sql_unpivot",
    """SELECT s_suppkey, measure, amount FROM (
  SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier)
UNPIVOT (amount FOR measure IN (s_acctbal AS balance, nation AS nation))""",
    """SELECT s_suppkey, 'balance' AS measure, s_acctbal AS amount FROM supplier
UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier""",
)

statement(
    "sql_string",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, substr(p_name, 2, 4) AS part_of,
       trim(concat('  ', p_type, ' ')) AS trimmed, length(p_name) AS n_chars,
       replace(p_brand, '#', '-') AS dashed, regexp_replace(p_brand, '[0-9]+', 'N') AS masked,
       regexp_extract(p_brand, '([0-9]+)', 1) AS digits, split(p_name, ' ')[0] AS first_word,
       concat_ws('/', p_brand, p_type) AS joined, lpad(p_type, 12, '.') AS padded
FROM part""",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, substr(p_name, 2, 4) AS part_of,
       trim(concat('  ', p_type, ' ')) AS trimmed, CAST(length(p_name) AS INTEGER) AS n_chars,
       replace(p_brand, '#', '-') AS dashed, regexp_replace(p_brand, '[0-9]+', 'N') AS masked,
       regexp_extract(p_brand, '([0-9]+)', 1) AS digits, split_part(p_name, ' ', 1) AS first_word,
       concat_ws('/', p_brand, p_type) AS joined, lpad(p_type, 12, '.') AS padded
FROM part""",
)

statement(
    "sql_date",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(year FROM o_orderdate) AS INT) AS y,
       CAST(extract(quarter FROM o_orderdate) AS INT) AS q,
       CAST(min(o_orderdate + INTERVAL '10' DAY) AS DATE) AS due,
       CAST(max(date_diff(DAY, o_orderdate, TIMESTAMP_NTZ '2002-01-01 00:00:00')) AS BIGINT) AS age_days,
       count(*) AS n_orders
FROM orders GROUP BY 1, 2, 3""",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(year FROM o_orderdate) AS INT) AS y,
       CAST(extract(quarter FROM o_orderdate) AS INT) AS q,
       CAST(min(o_orderdate + INTERVAL '10' DAY) AS DATE) AS due,
       CAST(max(date_diff('day', o_orderdate, TIMESTAMP '2002-01-01 00:00:00')) AS BIGINT) AS age_days,
       count(*) AS n_orders
FROM orders GROUP BY 1, 2, 3""",
)

statement(
    "sql_math",
    f"""SELECT l_orderkey, l_linenumber, {snap_sql('power(l_quantity, 2) + ln(l_extendedprice)', 4)} AS mixed,
       CAST(floor(l_extendedprice) AS BIGINT) AS down, CAST(ceil(l_extendedprice) AS BIGINT) AS up,
       l_orderkey % 7 AS rest, l_orderkey div 7 AS whole, abs(l_discount - 0.05) < 0.011 AS near,
       {snap_sql('sqrt(l_quantity)', 4)} AS root, round(l_quantity / 4, 0) AS quarter
FROM lineitem""",
    f"""SELECT l_orderkey, l_linenumber, {snap_sql('power(l_quantity, 2) + ln(l_extendedprice)', 4)} AS mixed,
       CAST(floor(l_extendedprice) AS BIGINT) AS down, CAST(ceil(l_extendedprice) AS BIGINT) AS up,
       l_orderkey % 7 AS rest, l_orderkey // 7 AS whole, abs(l_discount - 0.05) < 0.011 AS near,
       {snap_sql('sqrt(l_quantity)', 4)} AS root, round(l_quantity / 4, 0) AS quarter
FROM lineitem""",
)

statement(
    "sql_json",
    """SELECT CAST(get_json_object(props, '$.k') AS BIGINT) AS k,
       try_variant_get(try_parse_json(props), '$.missing', 'string') AS missing,
       count(*) AS n_events, CAST(sum(variant_get(parse_json(props), '$.k', 'bigint')) AS BIGINT) AS k_sum
FROM events GROUP BY 1, 2""",
    """SELECT CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.missing' AS VARCHAR) AS missing,
       count(*) AS n_events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum
FROM events GROUP BY 1, 2""",
)

# Text for text what the other engine runs.
statement(
    "sql_functions",
    """SELECT CAST(epoch(time_bucket(INTERVAL '6 hours', ts)) AS BIGINT) AS bucket,
       CAST(epoch(time_bucket(INTERVAL '7 days', ts)) AS BIGINT) AS week,
       json_extract_string(props, '$.k') AS k, count(*) AS n_events, min(epoch_us(ts)) AS first_us
FROM events GROUP BY 1, 2, 3""",
)

statement(
    "sql_array_map",
    """SELECT word, count(*) AS n_parts, CAST(sum(n) AS BIGINT) AS letters FROM (
  SELECT explode(transform(filter(split(p_name, ' '), w -> length(w) > 3), w -> upper(w))) AS word,
         aggregate(transform(split(p_name, ' '), w -> length(w)), 0, (a, x) -> a + x) AS n
  FROM part) GROUP BY word""",
    """SELECT word, count(*) AS n_parts, CAST(sum(n) AS BIGINT) AS letters FROM (
  SELECT unnest([upper(w) FOR w IN string_split(p_name, ' ') IF length(w) > 3]) AS word,
         list_sum([length(w) FOR w IN string_split(p_name, ' ')]) AS n FROM part) GROUP BY word""",
)

statement(
    "sql_map",
    """SELECT s_suppkey, m['nation'] AS nation, size(m) AS n_entries, array_join(sort_array(map_keys(m)), ',') AS names
FROM (SELECT s_suppkey, map('nation', n_name, 'region', r_name) AS m
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    """SELECT s_suppkey, n_name AS nation, 2 AS n_entries, 'nation,region' AS names
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)

# Spark counts each distinct value here, and values are amounts of cents below a few hundred.
statement(
    "sql_quantile",
    f"""SELECT event_type, {snap_sql('percentile_cont(0.5) WITHIN GROUP (ORDER BY value)', 4)} AS median,
       percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS p90,
       {snap_sql('percentile_cont(0.25) WITHIN GROUP (ORDER BY value)', 4)} AS q1
FROM events GROUP BY event_type""",
    f"""SELECT event_type, {snap_sql('quantile_cont(value, 0.5)', 4)} AS median,
       quantile_disc(value, 0.9) AS p90, {snap_sql('quantile_cont(value, 0.25)', 4)} AS q1
FROM events GROUP BY event_type""",
)


@query(
    "sql_asof_join",
    """WITH done AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS done_key, count(*) AS n_done
  FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderdate)
SELECT o.o_orderkey, done.done_key, done.n_done FROM orders o ASOF LEFT JOIN done
  ON o.o_custkey = done.o_custkey AND o.o_orderdate >= done.o_orderdate WHERE o.o_orderstatus = 'O'""",
)
def sql_asof_join(spark, sf_dir):
    """Each open order with its customer's latest finished orders at or before it."""
    orders = data.table(spark, sf_dir, "orders")
    done = (
        orders.filter("o_orderstatus = 'F'")
        .groupBy("o_custkey", F.col("o_orderdate").alias("done_at"))
        .agg(F.max("o_orderkey").alias("done_key"), F.count("*").alias("n_done"))
    )
    open_orders = orders.filter("o_orderstatus = 'O'")
    joined = as_of_join(
        open_orders, done, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["done_at"], ["done_key", "n_done"]
    )
    return joined.select("o_orderkey", "done_key", "n_done")


DAY = 86_400_000_000


@query(
    "range_join",
    f"""SELECT o_orderkey, count(*) AS n_lines, {snap_sql('sum(l_quantity)', 2)} AS quantity,
       min(l_shipdate) AS first_shipped
FROM orders JOIN lineitem ON o_orderdate >= l_shipdate AND o_orderdate < l_shipdate + to_days(l_linenumber % 3 + 1)
GROUP BY o_orderkey""",
)
def range_join(spark, sf_dir):
    """Each order with the lines that are on their way when it comes in: two large sides and no equality."""
    orders = data.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ordered")
    )
    lines = data.table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_shipdate",
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("shipped"),
        (F.pmod("l_linenumber", F.lit(3)) + 1).alias("days"),
    )
    way = Span(F.col("shipped"), F.col("shipped") + F.col("days") * DAY)
    partials = {"n": F.count("*"), "sum": F.sum("l_quantity"), "first": F.min("l_shipdate")}
    merged = {"n_lines": F.sum("n"), "total": F.sum("sum"), "first_shipped": F.min("first")}
    found = covering_aggregates(orders, lines, F.col("ordered"), way, partials, merged)
    return found.groupBy("o_orderkey").agg(
        F.sum("n_lines").alias("n_lines"),
        snap(F.sum("total"), 2).alias("quantity"),
        F.min("first_shipped").alias("first_shipped"),
    )


# A total order of the lines, and what rows of equal place are.
TOTAL = ["l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
ORDERED = ", ".join(TOTAL)


@query(
    "window_whole_table",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  row_number() OVER w AS row_number, rank() OVER p AS rank, dense_rank() OVER p AS dense_rank,
  CAST(ntile(7) OVER w AS INT) AS ntile, lag(l_quantity, 2) OVER w AS before, lead(l_quantity) OVER w AS after,
  {snap_sql('sum(l_quantity) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)', 2)} AS around,
  count(*) OVER (ORDER BY l_shipdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS last_month
FROM lineitem WINDOW w AS (ORDER BY {ORDERED}), p AS (ORDER BY l_shipdate)""",
)
def window_whole_table(spark, sf_dir):
    """Ranks, neighbours, frames of rows and of days over all lines at once, no PARTITION BY."""
    lines = data.table(spark, sf_dir, "lineitem").select(*TOTAL)
    rows = ranked(lines, TOTAL, peers=["l_shipdate"], tiles=7)
    rows = rows.withColumn("day_us", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    rows = span_sums(rows, "day_us", 30 * DAY, {"last_month": F.lit(1).cast("bigint")})
    quantity = F.col("l_quantity")
    rows = framed(
        rows,
        {"before": (F.max(quantity), -2, -2), "after": (F.max(quantity), 1, 1), "around": (F.sum(quantity), -3, 1)},
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "row_number", "rank", "dense_rank",
        "ntile", "before", "after", snap("around", 2).alias("around"), "last_month",
    )


@query(
    "window_hot_partition",
    """SELECT event_id, kind, row_number() OVER w AS row_number, rank() OVER p AS rank,
  lag(event_id) OVER w AS before, count(*) OVER (PARTITION BY kind ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)
    AS last_hour
FROM (SELECT event_id, CASE WHEN event_id % 10 < 6 THEN NULL ELSE event_type END AS kind,
  epoch_us(ts) // 1000000 AS s FROM events)
WINDOW w AS (PARTITION BY kind ORDER BY s, event_id), p AS (PARTITION BY kind ORDER BY s)""",
)
def window_hot_partition(spark, sf_dir):
    """The same by a partition key that most rows lack."""
    events = data.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 >= 6, F.col("event_type")).alias("kind"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"),
    )
    rows = ranked(events, ["s", "event_id"], ["kind"], peers=["s"])
    rows = span_sums(rows, "s", 3600, {"last_hour": F.lit(1).cast("bigint")}, ["kind"])
    rows = framed(rows, {"before": (F.max("event_id"), -1, -1)}, ["kind"])
    return rows.select("event_id", "kind", "row_number", "rank", "before", "last_hour")
