"""Ordered scans and size-checked joins, with groups that hold a third of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans import sizing
from tidemark.plans.ordered import RANGE, OrderedRows, Running, as_of_join
from tidemark.plans.sizing import dealt
from tidemark.session import prepare


def skewed(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [
        ("hot" if rng.random() < 0.4 else f"g{rng.randrange(50)}", i, rng.choice([None, rng.randrange(1000)]))
        for i in range(n)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, i long, v long")


SPECS = {
    "hi": ("max", False),
    "lo": ("min", False),
    "total": ("sum", False),
    "n": ("count", False),
    "hi_before": ("max", True),
    "total_before": ("sum", True),
    "n_before": ("count", True),
}


@pytest.mark.parametrize("group", [[], ["g"]])
def test_running_equals_plain_window(spark, group):
    frame = skewed(spark)
    ordered = OrderedRows.of(frame, ["i"], group, ranges=13)
    found = ordered.running(**{k: Running(kind, F.col("v"), before) for k, (kind, before) in SPECS.items()})
    window = Window.partitionBy(*(group or [F.lit(0)])).orderBy("i")
    expected = frame
    for name, (kind, before) in SPECS.items():
        frame_spec = window.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        expected = expected.withColumn(name, getattr(F, kind)("v").over(frame_spec))
    columns = ["g", "i", "v", *SPECS]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.select(columns).collect()))


def test_hot_group_is_split(spark):
    """No range holds much more than its share, though one group holds 40 % of the rows."""
    ordered = OrderedRows.of(skewed(spark), ["i"], ["g"], ranges=10)
    sizes = [r["count"] for r in ordered.rows.groupBy(RANGE).count().collect()]
    assert max(sizes) < 2.5 * 4000 / 10


def test_null_groups_and_empty_input(spark):
    frame = spark.createDataFrame([(None, 1, 5), (None, 2, 3), ("a", 1, 1)], "g string, i long, v long")
    found = OrderedRows.of(frame, ["i"], ["g"], ranges=3).running(s=Running("sum", F.col("v")))
    assert sorted(r.s for r in found.collect()) == [1, 5, 8]
    assert OrderedRows.of(frame.filter("false"), ["i"], ["g"]).running(s=Running("sum", F.col("v"))).count() == 0


def test_as_of_join(spark):
    rng = random.Random(5)
    left = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.randrange(500), i) for i in range(800)]
    right = sorted({("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", rng.randrange(500)) for _ in range(400)})
    right = [(k, t, i) for i, (k, t) in enumerate(right)]
    found = as_of_join(
        spark.createDataFrame(left, "k string, t long, id long"),
        spark.createDataFrame(right, "k string, rt long, x long"),
        ["k"], ["t", "id"], ["rt"], ["x"],
    )
    for row in found.collect():
        candidates = [(rt, x) for k, rt, x in right if k == row.k and rt <= row.t]
        assert row.x == (max(candidates)[1] if candidates else None)
    assert found.count() == len(left)


@pytest.fixture(scope="module")
def sides(spark):
    rows = skewed(spark).withColumnRenamed("g", "k")
    table = spark.createDataFrame([("hot", 1)] + [(f"g{i}", i) for i in range(0, 50, 2)], "k string, x long")
    return rows, table


def answer(frame):
    return sorted(map(str, frame.select("k", "i", "v", "x").collect()))


def test_salted_join_equals_plain(spark, sides):
    rows, table = sides
    plain = rows.join(table, "k", "left")
    salted = sizing.salted_left_join(rows, table, ["k"], ["i"], target_rows=40)
    assert answer(salted) == answer(plain)
    assert salted.columns == plain.columns


def test_no_task_above_the_target(spark):
    """30 % null keys, 30 % of one key: no (key, salt) that meets in a task is far above the target."""
    rows = spark.range(20_000).selectExpr(
        "case when id % 10 < 3 then null when id % 10 < 6 then 'hot' else concat('k', id % 997) end k",
        "id i",
        "id % 7 v",
    )
    table = spark.createDataFrame([("hot", 1), ("k5", 2)], "k string, x long")
    target = 500
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        joined = sizing.salted_left_join(rows, table, ["k"], ["i"], target_rows=target)
        joined = joined.hint("merge").withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("task").count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 4 * target
        plain = rows.join(table, "k", "left")
        assert answer(joined) == answer(plain)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_size_decides(spark, sides):
    rows, table = sides
    small = sizing.left_join(rows, table, ["k"], ["i"])
    large = sizing.left_join(rows, table, ["k"], ["i"], broadcast_bytes=10)
    assert answer(small) == answer(large)
    assert "_salt" not in small._jdf.queryExecution().analyzed().toString()
    assert "_salt" in large._jdf.queryExecution().analyzed().toString()


def test_null_keys_survive(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, i long")
    table = spark.createDataFrame([("a", 5)], "k string, x long")
    for limit in (1 << 20, 1):
        found = sizing.left_join(rows, table, ["k"], ["i"], broadcast_bytes=limit)
        assert sorted((r.i, r.x) for r in found.collect()) == [(1, None), (2, 5)]


def test_measured_bytes(spark):
    frame = spark.createDataFrame([("abcd", 1), (None, 2)], "s string, n long")
    assert sizing.measured_bytes(frame) == (4 + 16 + 16) + (0 + 16 + 16)
    assert sizing.measured_bytes(frame.filter("false")) == 0


def test_ranges_grow_with_the_data(spark):
    """The default number of ranges follows the size of the rows, not only the shuffle's width of 4."""
    small = {"advisoryPartitionSizeInBytes": "32k", "coalescePartitions.minPartitionSize": "16k"}
    prepare(spark)
    for name, value in small.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        rows = spark.range(400_000).selectExpr("id", "xxhash64(id) AS i")
        ordered = OrderedRows.of(rows, ["i"])
        assert ordered.rows.select(RANGE).distinct().count() > 20
        found = ordered.running(n=Running("count", F.lit(1)), low=Running("max", F.col("i"), before=True))
        assert found.agg(F.max("n"), F.count_distinct("n"), F.count_if(F.col("low") >= F.col("i"))).first()[:] == (
            400_000, 400_000, 0,
        )
    finally:
        for name in small:
            spark.conf.unset(f"spark.sql.adaptive.{name}")


def test_work_is_dealt_over_all_tasks(spark):
    rows = dealt(spark.range(1000).coalesce(1), "id")
    assert rows.select(F.spark_partition_id()).distinct().count() == 4
