"""Window assignment, aggregates, closing and corrections."""

import math
import random
from datetime import datetime, timezone

import pytest
from helpers import BASE, EPOCH, at, naive, seconds
from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.functions.times import Windows, window_bounds
from tidemark.operators import windows as w
from tidemark.operators.corrections import WindowReplay, latest

SECONDS = int((BASE - EPOCH).total_seconds())


def events(spark, *rows, fields="value double"):
    """Rows of (offset from the base time, field values ...)."""
    return spark.createDataFrame([(at(r[0]), *r[1:]) for r in rows], f"event_time timestamp, {fields}")


@pytest.mark.parametrize(
    ("size", "slide", "offset", "starts"),
    [
        (10, 10, 7, [0]),
        (10, 10, 10, [10]),
        (10, 5, 7, [0, 5]),
        (10, 4, 9, [0, 4, 8]),
        (10, 4, 3, [-4, 0]),
        (300, 1, 150, list(range(-149, 151))),
    ],
)
def test_assignment(spark, size, slide, offset, starts):
    assert SECONDS % 20 == 0
    rows = w.assign(events(spark, (offset, 1.0)), Windows(size, slide)).collect()
    found = sorted(int((r.window_start - naive(BASE)).total_seconds()) for r in rows)
    assert found == starts
    assert all((r.window_end - r.window_start).total_seconds() == size for r in rows)


@pytest.mark.parametrize(("size", "slide"), [(0, 1), (10, 0), (5, 10), (-1, 1)])
def test_bad_shapes(size, slide):
    with pytest.raises(ValueError):
        Windows(size, slide)


def test_ids_round_trip(spark):
    row = w.assign(events(spark, (1, 1.0)), Windows(10, 10)).first()
    assert row.window_id == f"{float(SECONDS)}_{float(SECONDS + 10)}"
    back = spark.createDataFrame([(row.window_id,), ("oops",)], "i string").select(*window_bounds(F.col("i"))).collect()
    assert (back[0].window_start, back[0].window_end) == (row.window_start, row.window_end)
    assert back[1].window_start is None


def test_times_before_the_epoch(spark):
    frame = spark.createDataFrame([(datetime(1969, 12, 31, 23, 59, 57, tzinfo=timezone.utc), 1.0)], "event_time timestamp, value double")
    assert w.aggregate(frame, Windows(10, 10), ["value"]).first().window_id == "-10.0_0.0"


def test_basic_aggregates(spark):
    row = w.aggregate(events(spark, (1, 10.0), (2, 20.0), (3, 30.0)), Windows(10, 10), ["value"]).first()
    assert (row.event_count, row.value_sum, row.value_min, row.value_max, row.value_avg) == (3, 60, 10, 30, 20)


def test_missing_field_does_not_count_in_average(spark):
    row = w.aggregate(events(spark, (1, 10.0), (2, None)), Windows(10, 10), ["value"]).first()
    assert (row.event_count, row.value_sum, row.value_avg) == (2, 10, 10)
    none = w.aggregate(events(spark, (1, None)), Windows(10, 10), ["value"])
    packed = none.select(w.packed(w.aggregations(["value"])).alias("j")).first().j
    assert packed == '{"count":1.0}'


def test_nan_is_no_extreme(spark):
    row = w.aggregate(events(spark, (1, math.nan), (2, 5.0)), Windows(10, 10), ["value"]).first()
    assert (row.value_min, row.value_max) == (5, 5) and math.isnan(row.value_sum)


def test_two_fields(spark):
    frame = events(spark, (1, 100.0, 5), (2, 200.0, 3), fields="price double, quantity int")
    row = w.aggregate(frame, Windows(10, 10), ["price", "quantity"]).first()
    assert (row.price_sum, row.quantity_sum, row.quantity_max) == (300, 8, 5)


def test_found_fields(spark):
    rows = [(at(1), '{"value": 42.0, "name": "x", "active": true}'), (at(2), '{"q": 3}'), (at(3), "{}")]
    facts = spark.createDataFrame(rows, "event_time timestamp, payload_json string")
    values = payload.numeric_fields(facts, ["event_time"])
    row = w.aggregate_fields(facts, values, Windows(10, 10)).first()
    assert row.event_count == 3
    assert row.aggregations == {
        "count": 3.0,
        **{f"value_{p}": 42.0 for p in ("sum", "min", "max", "avg")},
        **{f"q_{p}": 3.0 for p in ("sum", "min", "max", "avg")},
    }


def test_unpack_of_bad_text(spark):
    frame = spark.createDataFrame([('{"count":1.0}',), ("oops",), (None,)], "j string")
    assert [r.m for r in frame.select(w.unpacked("j").alias("m")).collect()] == [{"count": 1.0}, {}, {}]


def test_sums_over_windows(spark):
    rng = random.Random(2)
    frame = events(spark, *[(rng.randrange(5000), 1.0) for _ in range(2000)])
    tumbling = w.aggregate(frame, Windows(60, 60), []).agg(F.sum("event_count")).first()[0]
    sliding = w.aggregate(frame, Windows(60, 15), []).agg(F.sum("event_count")).first()[0]
    assert (tumbling, sliding) == (2000, 8000)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("span", [200, 100_000])
def test_block_sums_equal_repeated_panes(spark, monkeypatch, keys, span):
    """Dense and sparse events; both ways of merging panes give the same windows."""
    rng = random.Random(span)
    rows = [(rng.randrange(span), rng.choice([None, 1.0, 2.5, -7.0]), rng.choice("ab")) for _ in range(400)]
    frame = events(spark, *rows, fields="value double, k string")
    shape = Windows(60, 2)
    assert shape.wide
    by_block = sorted(map(str, w.aggregate(frame, shape, ["value"], keys).collect()))
    monkeypatch.setattr(Windows, "wide", False)
    assert by_block == sorted(map(str, w.aggregate(frame, shape, ["value"], keys).collect()))


def test_keys(spark):
    frame = events(spark, (1, 1.0, "a"), (2, 2.0, "b"), (3, 4.0, "a"), fields="value double, k string")
    found = {r.k: r.value_sum for r in w.aggregate(frame, Windows(10, 10), ["value"], ["k"]).collect()}
    assert found == {"a": 5, "b": 2}


# -- closing and corrections -----------------------------------------------------------------------

SCHEMA = "event_time timestamp, value double, ingest_time timestamp, partition int, offset long"


def run_of(spark, rows, windows, lateness, idle=None):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(8)
    return WindowReplay.of(frame, windows, ["value"], lateness, idle)


def arriving(*pairs):
    return [(at(offset), value, at(i), 0, i) for i, (offset, value) in enumerate(pairs)]


def test_close_at_equality(spark):
    run = run_of(spark, arriving((5, 1.0), (20, 2.0)), Windows(10, 10), 10)
    assert [r.event_count for r in run.closed().collect()] == [1]
    early = run_of(spark, arriving((5, 1.0), (19.999999, 2.0)), Windows(10, 10), 10)
    assert early.closed().count() == 0 and early.open().count() == 2


def test_lifecycle(spark):
    rows = arriving((5, 10.0), (6, 20.0), (20, 1.0), (7, 5.0), (8, 2.0))
    run = run_of(spark, rows, Windows(10, 10), 10)
    first = run.closed().first()
    assert (first.event_count, first.value_sum) == (2, 30)
    fixes = run.corrections().orderBy("correction_version").collect()
    assert [(r.correction_version, r.event_count, r.value_sum) for r in fixes] == [(1, 3, 35), (2, 4, 37)]
    assert [(r.previous.correction_version, r.previous.event_count, r.previous.value_sum) for r in fixes] == [
        (0, 2, 30),
        (1, 3, 35),
    ]
    results = run.results()
    flags = {r.correction_version: r.is_correction for r in results.collect()}
    assert flags == {0: False, 1: True, 2: True}
    newest = latest(results).first()
    assert (newest.correction_version, newest.event_count) == (2, 4)


def test_late_event_without_window(spark):
    run = run_of(spark, arriving((0, 1.0), (3600, 1.0), (1800, 5.0)), Windows(10, 10), 10)
    assert run.corrections().count() == 0


def model(rows, windows, lateness, idle, scope):
    """One event at a time: watermark, then closing, then the event itself."""
    size, slide = windows.size_seconds, windows.slide_seconds
    state, closed, first, fixes = {}, {}, {}, []
    mark = top = previous = None

    def add(s, value):
        entry = state.setdefault(s, [0, 0.0, None, None])
        entry[0] += 1
        if value is not None:
            entry[1] += value
            entry[2] = value if entry[2] is None else min(entry[2], value)
            entry[3] = value if entry[3] is None else max(entry[3], value)

    for event, value, arrived, _, i in sorted(rows, key=lambda r: r[2:]):
        t, a = (event - EPOCH).total_seconds(), (arrived - EPOCH).total_seconds()
        if idle and previous is not None and a - previous > idle:
            mark = max(mark, a - idle)
        previous = a
        top = t if top is None else max(top, t)
        mark = top - lateness if mark is None else max(mark, top - lateness)
        for s in [s for s in state if s not in closed and s + size <= mark]:
            closed[s], first[s] = 0, (tuple(state[s]), a)
        accepted = t >= mark - lateness
        starts = [s for s in range(int(t // slide * slide), int(t - size) - slide, -slide) if s <= t < s + size]
        for s in starts:
            if s + size > mark:
                if accepted:
                    add(s, value)
            elif s in closed:
                add(s, value)
                closed[s] += 1
                fixes.append((s, closed[s], tuple(state[s]), a))
                if scope == "newest":
                    break
    still_open = {s: tuple(v) for s, v in state.items() if s not in closed}
    # Windows the last event closed.
    for s in [s for s in still_open if s + size <= mark]:
        first[s] = (still_open.pop(s), a)
    return first, fixes, still_open


def shown(r):
    return (r.event_count, pytest.approx(r.value_sum or 0.0), r.value_min, r.value_max)


@pytest.mark.parametrize(
    ("size", "slide", "idle", "scope"),
    [
        (60, 15, None, "all"),
        (60, 60, None, "newest"),
        (60, 25, 100, "all"),
        (60, 15, 100, "newest"),
        (30, 1, 100, "all"),
    ],
)
def test_equals_sequential_run(spark, size, slide, idle, scope):
    rng = random.Random(size + slide)
    clock, rows = 0.0, []
    for i in range(600):
        clock += rng.choice([0, 0, 1, 3, 10]) if rng.random() < 0.98 else 300
        late = rng.choice([0, 0, 1, 5, 20, 45, 90, 200])
        value = rng.choice([None, 1.0, 2.5, -4.0, 100.25])
        rows.append((at(clock - late), value, at(clock), i % 3, i))
    windows = Windows(size, slide)
    first, fixes, still_open = model(rows, windows, 20, idle, scope)
    run = run_of(spark, rows, windows, 20, idle)

    closed = {seconds(r.window_start): (shown(r), seconds(r.emitted_at)) for r in run.closed_with_time().collect()}
    assert {s: (state, when) for s, (state, when) in first.items()} == {
        s: (tuple(v[0]), v[1]) for s, v in closed.items()
    }
    corrected = {
        (seconds(r.window_start), r.correction_version): (shown(r), seconds(r.emitted_at))
        for r in run.corrections(scope).collect()
    }
    assert {(s, version): (state, when) for s, version, state, when in fixes} == corrected
    opened = {seconds(r.window_start): shown(r) for r in run.open().collect()}
    assert still_open == opened
    versions = {}
    for s, version, *_ in fixes:
        versions.setdefault(s, []).append(version)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in versions.values())


def test_corrections_of_a_hot_window(spark):
    """Most late events fall into one window; its versions must still be contiguous."""
    rows = arriving((5, 1.0), (100, 1.0), *[(6, 1.0)] * 700, (101, 1.0), *[(55, 1.0)] * 5)
    fixes = run_of(spark, rows, Windows(10, 10), 10).corrections()
    found = fixes.agg(F.count("*"), F.max("correction_version"), F.max("event_count"), F.count_distinct("correction_version")).first()
    assert list(found) == [700, 700, 701, 700]
