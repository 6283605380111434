"""Operational measures."""

import random
from datetime import timedelta

import pytest
from helpers import BASE, at, naive

from tidemark.operators import metrics


def arrivals(spark, *offsets):
    return spark.createDataFrame([(at(o), at(o)) for o in offsets], "event_time timestamp, ingest_time timestamp")


def test_throughput(spark):
    rows = metrics.throughput(arrivals(spark, 0, 0.5, 0.9, 2.1), 1).orderBy("span_start").collect()
    assert [(r.n_events, r.events_per_second) for r in rows] == [(3, 3.0), (1, 1.0)]


@pytest.mark.parametrize(("n", "expected"), [(0, 0.0), (1, 0), (2, 1), (99, 98), (100, 99), (1000, 990), (1500, 1490)])
def test_p99(spark, n, expected):
    """Rank of the newest 1000 samples; values grow with time."""
    frame = spark.range(n).selectExpr("CAST(id AS DOUBLE) AS ms", "id")
    assert metrics.p99(frame, "ms", ["id"]).first().p99 == expected


def test_density_has_empty_points(spark):
    frame = arrivals(spark, -1800, -1799, -31, -30, -1, 0, 5)
    rows = metrics.event_density(frame, BASE).orderBy("point").collect()
    assert len(rows) == 60 and rows[0].span_start == naive(BASE) - timedelta(minutes=30)
    assert {r.point: r.n_events for r in rows if r.n_events} == {0: 2, 58: 1, 59: 2}


def test_bands(spark):
    rows = [(1.99, 49.0), (2.0, 50.0), (4.99, 199.0), (5.0, 200.0)]
    frame = spark.createDataFrame(rows, "lag_seconds double, latency_ms double")
    found = {(r.measure, r.band): r.n_rows for r in metrics.health_bands(frame).collect()}
    assert found == {(m, b): n for m in ("lag", "latency") for b, n in (("green", 1), ("amber", 2), ("red", 1))}


def test_recent_series(spark, monkeypatch):
    """Every span sees exactly the 29 before it, across the borders of the stretches too."""
    rng = random.Random(4)
    offsets = [rng.randrange(0, 9000) for _ in range(6000)] + [0, 8999]
    rows = metrics.recent_series(arrivals(spark, *offsets)).orderBy("span_start").collect()
    counts = [offsets.count(i) for i in range(9000)]
    assert len(rows) == 9000
    for i, row in enumerate(rows):
        last = counts[max(0, i - 29): i + 1]
        low, high = min(min(last), 0), max(max(last), 1)
        assert (row.events_per_second, row.low, row.high) == (counts[i], low, high)
        assert row.scaled == (counts[i] - low) / (high - low)


def test_batch_rates(spark):
    frame = spark.createDataFrame([(100, 2.0), (5, 0.0)], "n_rows long, elapsed_seconds double")
    assert [r.rows_per_second for r in metrics.batch_rates(frame).collect()] == [50.0, None]
