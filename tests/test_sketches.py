"""Distinct counts of windows from merged sketches."""

import random

import pytest
from helpers import at
from pyspark.sql import functions as F

from tidemark.functions.times import Windows
from tidemark.operators import sketches
from tidemark.operators import windows as w


def events(spark, count=3000, seed=4):
    rng = random.Random(seed)
    rows = [
        (at(rng.randrange(2000)), rng.choice(["x", "y"]), 1 if rng.random() < 0.3 else rng.choice([None, rng.randrange(900)]))
        for _ in range(count)
    ]
    return spark.createDataFrame(rows, "event_time timestamp, kind string, user long")


@pytest.mark.parametrize("shape", [Windows(60, 60), Windows(60, 25), Windows(300, 10), Windows(130, 10), Windows(128, 1)])
@pytest.mark.parametrize("keys", [[], ["kind"]])
def test_windows_from_panes(spark, shape, keys):
    frame = events(spark)
    panes = sketches.pane_sketches(frame, shape, "user", keys)
    found = sketches.estimated(sketches.window_sketches(panes, shape, keys), "n")
    found = {tuple(r)[:-1]: r.n for r in found.select(*keys, shape.bounds("_start")[0], "n").collect()}
    exact = w.assign(frame.filter("user is not null"), shape).groupBy(*keys, "window_id")
    exact = {tuple(r)[:-1]: r.n for r in exact.agg(F.count_distinct("user").alias("n")).collect()}
    assert found.keys() == exact.keys()
    assert all(abs(found[k] - exact[k]) <= max(1, 0.05 * exact[k]) for k in exact)


def test_late_events_are_merged(spark):
    shape, frame = Windows(60, 20), events(spark, 400)
    late = F.col("user") % 3 == 0
    parts = [sketches.pane_sketches(frame.filter(part), shape, "user") for part in (late, ~late)]
    merged = sketches.merged(parts[0].unionByName(parts[1]), ["_pane"])
    whole = sketches.pane_sketches(frame, shape, "user")
    count = lambda rows: sorted(map(str, sketches.estimated(rows, "n").select("_pane", "n").collect()))
    assert count(merged) == count(whole)
    assert sketches.pane_sketches(frame.filter("false"), shape, "user").count() == 0
