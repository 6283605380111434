"""Exact quantiles against sorted lists, with a hot group and a hot value."""

import math
import random

from tidemark.operators.quantiles import exact_quantiles


def expected(values, share, continuous):
    values = sorted(values)
    if not continuous:
        return values[max(math.ceil(share * len(values)) - 1, 0)]
    place = share * (len(values) - 1)
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))


def test_quantiles(spark):
    rng = random.Random(1)
    rows, groups = [], {}
    for i in range(3000):
        group = "hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}"
        value = 5.0 if rng.random() < 0.3 else round(rng.uniform(-10, 10), 3)
        if rng.random() < 0.05:
            value = None
        rows.append((group, value, i))
        if value is not None:
            groups.setdefault(group, []).append(value)
    frame = spark.createDataFrame([*rows, ("none", None, -1)], "g string, v double, i long")
    found = exact_quantiles(
        frame, ["g"], "v", ["i"], {"median": 0.5, "top": 1.0, "q1": 0.25}, {"p90": 0.9, "low": 0.0}
    )
    assert found.columns == ["g", "median", "top", "q1", "p90", "low"]
    rows = {r.g: r for r in found.collect()}
    assert set(rows) == set(groups)
    for group, values in groups.items():
        r = rows[group]
        for name, share in (("median", 0.5), ("top", 1.0), ("q1", 0.25)):
            assert abs(r[name] - expected(values, share, True)) < 1e-9
        assert r.p90 == expected(values, 0.9, False) and r.low == min(values)


def test_empty(spark):
    frame = spark.createDataFrame([], "g string, v double, i long")
    assert exact_quantiles(frame, ["g"], "v", ["i"], {"m": 0.5}).count() == 0
