"""Ranks and frames over whole orders against plain window functions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.neighbours import framed, ranked, span_sums


def rows_of(spark, count=1500, seed=2):
    rng = random.Random(seed)
    rows = [
        (
            rng.choice([None, None, "a", "b"]),
            None if rng.random() < 0.02 else 100 if rng.random() < 0.3 else rng.randrange(400),
            i,
            rng.choice([None, rng.randrange(50)]),
        )
        for i in range(count)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, k long, i long, v long")


def same(found, expected, columns):
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, expected.select(*columns).collect()))


@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("tiles", [4, 2000])
def test_ranks(spark, group, tiles):
    frame = rows_of(spark)
    part = Window.partitionBy(*(group or [F.lit(0)]))
    whole, peers = part.orderBy("k", "i"), part.orderBy("k")
    expected = frame.withColumns(
        {
            "row_number": F.row_number().over(whole), "rank": F.rank().over(peers),
            "dense_rank": F.dense_rank().over(peers), "ntile": F.ntile(tiles).over(whole),
        }
    )
    found = ranked(frame, ["k", "i"], group, peers=["k"], tiles=tiles)
    same(found, expected, ["g", "k", "i", "v", "row_number", "rank", "dense_rank", "ntile"])


@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("block", [1, 7, 100, 10_000])
def test_frames_of_rows(spark, group, block):
    frame = ranked(rows_of(spark, 700), ["k", "i"], group)
    columns = {
        "before": (F.max("v"), -3, -3), "after": (F.max("v"), 2, 2), "around": (F.sum("v"), -5, 4),
        "least": (F.min("v"), 1, 3), "n": (F.count("v"), -2, 0),
    }
    window = Window.partitionBy(*(group or [F.lit(0)])).orderBy("k", "i")
    expected = frame.withColumns({name: x.over(window.rowsBetween(a, b)) for name, (x, a, b) in columns.items()})
    same(framed(frame, columns, group, block_rows=block), expected, ["g", "k", "i", "row_number", *columns])


@pytest.mark.parametrize("group", [[], ["g"]])
@pytest.mark.parametrize("span", [0, 30, 10**6])
def test_sums_over_a_span(spark, group, span):
    frame = ranked(rows_of(spark, 900), ["k", "i"], group)
    window = Window.partitionBy(*(group or [F.lit(0)])).orderBy("k").rangeBetween(-span, 0)
    expected = frame.withColumns({"n": F.count(F.lit(1)).over(window), "total": F.sum(F.coalesce("v", F.lit(0))).over(window)})
    sums = {"n": F.lit(1).cast("bigint"), "total": F.coalesce("v", F.lit(0))}
    same(span_sums(frame, "k", span, sums, group), expected, ["g", "k", "i", "n", "total"])


def test_no_task_holds_the_whole_order(spark):
    rows = ranked(rows_of(spark, 300), ["k", "i"], peers=["k"], tiles=3)
    rows = framed(rows, {"before": (F.max("v"), -1, -1)}, block_rows=50)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert framed(rows.filter("false").drop("before"), {"before": (F.max("v"), -1, -1)}).count() == 0
    assert ranked(rows_of(spark, 300).filter("false"), ["k", "i"], tiles=3).count() == 0
