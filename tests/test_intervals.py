"""Interval joins against pairs found one by one, with a third of all rows in one bin."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.plans.intervals import Span, covering_aggregates, interval_join


def rows_of(rng, count, hot, longest):
    out = []
    for i in range(count):
        start = 5000 + rng.randrange(20) if rng.random() < hot else rng.randrange(-3000, 9000)
        out.append((i, start, start + rng.choice([0, 1, 3, rng.randrange(longest)])))
    return out + [(count, None, 5), (count + 1, 5, None), (count + 2, 9, 3)]


def plain(left, right):
    good = [[r for r in rows if None not in r and r[1] < r[2]] for rows in (left, right)]
    return sorted((a, b) for a, s, e in good[0] for b, t, u in good[1] if s < u and t < e)


@pytest.mark.parametrize(("target", "width"), [(10**6, None), (20, None), (7, 4), (50, 1000)])
def test_equals_all_pairs(spark, target, width):
    rng = random.Random(target)
    left, right = rows_of(rng, 300, 0.4, 60), rows_of(rng, 200, 0.35, 500)
    one = spark.createDataFrame(left, "a long, s long, e long").repartition(4)
    two = spark.createDataFrame(right, "b long, t long, u long").repartition(3)
    found = interval_join(
        one, two, Span(F.col("s"), F.col("e")), Span(F.col("t"), F.col("u")), width, target_rows=target
    )
    assert found.columns == ["a", "s", "e", "b", "t", "u"]
    assert sorted((r.a, r.b) for r in found.collect()) == plain(left, right)


def test_points_copies_and_empty_sides(spark):
    one = spark.createDataFrame([(1, 5), (1, 5), (2, 6)], "a long, at long")
    two = spark.createDataFrame([(7, 5, 6), (7, 5, 6), (8, 0, 100)], "b long, t long, u long")
    span = Span(F.col("t"), F.col("u"))
    found = interval_join(one, two, Span.at(F.col("at")), span)
    assert sorted((r.a, r.b) for r in found.collect()) == [(1, 7)] * 4 + [(1, 8)] * 2 + [(2, 8)]
    assert interval_join(one, two.filter("false"), Span.at(F.col("at")), span).count() == 0
    assert interval_join(one.filter("false"), two, Span.at(F.col("at")), span).count() == 0


def test_plan_and_shares(spark):
    """No row is compared with each other, and a hot bin is dealt over many tasks."""
    one = spark.range(3000).selectExpr("id a", "5000 + id % 10 at")
    two = spark.range(3000).selectExpr("id b", "5000 + id % 10 t", "5001 + id % 10 u")
    found = interval_join(one, two, Span.at(F.col("at")), Span(F.col("t"), F.col("u")), 100, target_rows=300)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 3000 * 300


def covered(points, intervals):
    return covering_aggregates(
        points,
        intervals,
        F.col("at"),
        Span(F.col("t"), F.col("u")),
        {"n": F.count("*"), "low": F.min("b")},
        {"n_over": F.sum("n"), "lowest": F.min("low")},
    )


def test_covering_aggregates_equal_all_pairs(spark):
    rng = random.Random(3)
    points = [(i, rng.choice([None, 7, 7, rng.randrange(-50, 120)])) for i in range(300)]
    right = rows_of(rng, 200, 0.35, 50)
    over = {i: [b for b, t, u in right if None not in (t, u) and at is not None and t <= at < u] for i, at in points}
    found = covered(
        spark.createDataFrame(points, "a long, at long").repartition(3),
        spark.createDataFrame(right, "b long, t long, u long").repartition(3),
    )
    assert found.columns == ["a", "at", "n_over", "lowest"]
    assert {r.a: (r.n_over, r.lowest) for r in found.collect()} == {i: (len(b), min(b)) for i, b in over.items() if b}


def test_many_points_of_one_place_meet_many_equal_intervals(spark):
    """The pairs of rows would be 40 thousand millions."""
    points = spark.range(200_000).selectExpr("id a", "id % 3 at")
    found = covered(points, spark.range(200_000).selectExpr("id b", "id % 2 t", "2L u"))
    rows = found.groupBy("at").agg(F.count("*").alias("n"), F.min("n_over").alias("n_over")).collect()
    assert sorted((r.at, r.n, r.n_over) for r in rows) == [(0, 66667, 100_000), (1, 66667, 200_000)]
