"""Watermark replay: fixture cases, and equality with a one-event-at-a-time run."""

import random
from datetime import timedelta

import pytest
from helpers import BASE, at, naive
from pyspark.sql import functions as F

from tidemark.functions.times import Windows
from tidemark.operators import watermark

SCHEMA = "event_time timestamp, ingest_time timestamp, partition int, offset long"


def arrivals(spark, offsets, gaps=None):
    """Events by their offset from the base time, arriving a second apart unless told otherwise."""
    moments = gaps or range(len(offsets))
    rows = [(at(o), at(m), 0, i) for i, (o, m) in enumerate(zip(offsets, moments))]
    return spark.createDataFrame(rows, SCHEMA)


def replayed(frame, lateness=10.0, idle=None):
    rows = watermark.replay(frame, lateness, idle).orderBy("offset").collect()
    return [((r.watermark - naive(BASE)).total_seconds(), r.decision) for r in rows]


@pytest.mark.parametrize(
    ("offsets", "lateness", "last"),
    [
        ([0], 10, (-10, "accept")),
        ([0, -15], 10, (-10, "accept")),
        ([0, -20], 10, (-10, "accept")),
        ([0, -21], 10, (-10, "drop")),
        ([0, 30, 10], 10, (20, "accept")),
        ([0, -0.000001], 0, (0, "drop")),
        ([0, -7200], 3600, (-3600, "accept")),
        ([0, -7200.000001], 3600, (-3600, "drop")),
    ],
)
def test_decisions(spark, offsets, lateness, last):
    assert replayed(arrivals(spark, offsets), lateness)[-1] == last


def test_drop_counter(spark):
    frame = watermark.replay(arrivals(spark, [0, -25, -25, 1]))
    assert watermark.dropped_count(frame).first().late_dropped_count == 2
    assert {r.decision: r.n_events for r in watermark.decision_counts(frame).collect()} == {"accept": 2, "drop": 2}


@pytest.mark.parametrize(
    ("silence", "expected"),
    [(30, -10), (30.000001, 0.000001), (35, 5), (500, 470)],
)
def test_idle(spark, silence, expected):
    """An old event after a silence: longer than the timeout lifts the watermark."""
    frame = arrivals(spark, [0, -9], [0, silence])
    assert replayed(frame, 10, 30)[-1][0] == pytest.approx(expected, abs=1e-9)


def random_run(seed, n=1500):
    rng = random.Random(seed)
    clock, rows = 0.0, []
    for i in range(n):
        clock += rng.choice([0, 0, 0, 1, 2, 5, 50]) if rng.random() < 0.97 else 400
        late = rng.choice([0, 1, 3, 8, 15, 40, 90])
        rows.append((at(clock - late), at(clock), i % 3, i))
    return rows


def sequential(rows, lateness, idle):
    lag, quiet = timedelta(seconds=lateness), timedelta(seconds=idle) if idle else None
    mark = top = previous = None
    for event, arrived, *_ in sorted(rows, key=lambda r: r[1:]):
        if quiet and previous and arrived - previous > quiet:
            mark = max(mark, arrived - quiet)
        previous = arrived
        top = event if top is None else max(top, event)
        mark = top - lag if mark is None else max(mark, top - lag)
        yield mark, "accept" if event >= mark - lag else "drop"


@pytest.mark.parametrize("idle", [None, 60])
def test_equals_sequential_run(spark, idle):
    """Many events share an arrival second, so ties and hot seconds are covered."""
    rows = random_run(11)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    found = {
        (r.ingest_time, r.partition, r.offset): (r.watermark, r.decision)
        for r in watermark.replay(frame, 10, idle).collect()
    }
    ordered = sorted(rows, key=lambda r: r[1:])
    for (_, arrived, partition, offset), (mark, decision) in zip(ordered, sequential(rows, 10, idle)):
        assert found[(naive(arrived), partition, offset)] == (naive(mark), decision)
    assert len(found) == len(rows)


def test_lag_never_negative(spark):
    frame = watermark.with_lag(watermark.replay(arrivals(spark, [0, 100], [50, 51])))
    assert [r.lag_seconds for r in frame.orderBy("offset").collect()] == [60.0, 0.0]


def test_ticks_carry_over_silence(spark):
    frame = watermark.replay(arrivals(spark, [0, 5, 6], [0.5, 1.5, 5.5]))
    rows = watermark.ticks(frame).orderBy("wall_clock").collect()
    assert [(r.wall_clock - naive(BASE)).total_seconds() for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [(r.watermark - naive(BASE)).total_seconds() for r in rows] == [-10, -5, -5, -5, -5, -4]
    assert [r.lag_seconds for r in rows] == [11, 7, 8, 9, 10, 10]


@pytest.mark.parametrize("every", [1, 60, 7000])
def test_spine_has_every_multiple(spark, every):
    ends = spark.createDataFrame([(every * 3,), (every * 9000,)], "t long")
    found = watermark.spine(ends, "t", every).agg(F.count("*"), F.count_distinct("t"), F.min("t"), F.max("t")).first()
    assert list(found) == [8998, 8998, every * 3, every * 9000]


def test_closed_and_open_counts(spark):
    windows = Windows(30, 10)
    frame = watermark.replay(arrivals(spark, [0, 25, 3, 60, 35], None), 10)
    rows = watermark.closed_and_open(frame, windows).orderBy("offset").collect()
    # Watermarks: -10, 15, 15, 50, 50. Window ends of each event: 10..30, 30..50, 10..30, 70..90, 40..60.
    assert [(r.n_closed, r.n_open) for r in rows] == [(0, 3), (0, 3), (1, 2), (0, 3), (2, 1)]
