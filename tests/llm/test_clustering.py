"""Exact rounds against a plain run over all vectors, and what the approximations may claim."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import clustering


def plain(rows, clusters, rounds, dimensions, seed=clustering.SEED):
    """[(vec_id, cluster, distance)], centroids; every distance of every round computed."""
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(kept, key=lambda x: digest(x[0]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, own) if c == k]
            if mine:
                centroids[k] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def checked(found, rows, clusters=8, rounds=10, dimensions=64):
    want, centroids = plain(rows, clusters, rounds, dimensions)
    assert sorted(map(str, ((r.vec_id, r.cluster, r.distance) for r in found))) == sorted(map(str, want))
    for r in found:
        text = ",".join(map(str, centroids[r.cluster]))
        assert r.centroid_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.inertia == sum(d for _, _, d in want)


def groups(rng, count, centers, dimensions, spread):
    middles = [[rng.uniform(-1, 1) for _ in range(dimensions)] for _ in range(centers)]
    out = []
    for i in range(count):
        # A third of all vectors are one and the same.
        c = middles[0] if i % 3 == 0 else middles[rng.randrange(centers)]
        out.append((i, list(c) if i % 3 == 0 else [x + rng.gauss(0, spread) for x in c]))
    return out


@pytest.mark.parametrize("spread", [0.02, 0.4])
def test_equal_to_a_plain_run(spark, spread):
    rows = groups(random.Random(5), 400, 6, 64, spread)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    checked(clustering.clustered(table).collect(), rows)


def test_zones_are_left_out_where_all_is_settled(spark):
    rows = groups(random.Random(6), 600, 4, 64, 0.01)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    state = clustering.clustering(table, clusters=4)
    for _ in range(6):
        state.step()
    assert state.read[0] == list(range(len(clustering.ZONES) + 1))
    # Only a group that two of the first centroids share keeps vectors near a border.
    assert set(state.read[-1]) <= {0}
    plan = state.vectors.filter("zone in (1)").select("values")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan or "PartitionFilters: [(zone" in plan


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(2, 6))
def test_settled_is_nearest(seed, dimensions, clusters):
    rng = np.random.default_rng(seed)
    values = rng.integers(-300, 300, (40, dimensions)).astype(np.int32)
    centroids = rng.integers(-300, 300, (clusters, dimensions))
    centroids[-1] = centroids[0]
    low, high = values.min(0)[:, None], values.max(0)[:, None] + 1
    inner = np.sort(np.clip(rng.integers(-300, 300, (dimensions, clustering.CELLS - 1)), low, high), axis=1)
    ends = np.hstack((low, inner, high)).astype(np.int64)
    cells, radius = clustering.approximated(values, ends)
    assert (clustering.unpacked(clustering.packed(cells), dimensions) == cells).all()
    told = clustering.settled(cells, radius, ends, centroids)
    truth = clustering.distances(values, centroids).argmin(1)
    known = told != clustering.OPEN
    assert (told[known] == truth[known]).all()
    assert (clustering.nearest(values, told, centroids) == truth).all()


def test_odd_vectors(spark):
    rng = random.Random(9)
    own = lambda: [rng.uniform(-1, 1) for _ in range(64)]
    same = own()
    rows = [
        (1, None),
        (2, []),
        (3, own()[:63]),
        (4, own() + [0.0]),
        (5, [None] + own()[1:]),
        (6, [float("nan")] + own()[1:]),
        (7, [float("-inf")] + own()[1:]),
        (None, own()),
        (8, same),
        (8, same),
        (9, same),
        (10, [0.0] * 64),
        (11, [-0.0] * 64),
        (12, [1000.0] * 64),
        (-13, [-1e-9] * 64),
    ]
    full = [(i, v, "x", 1, 2, 3) for i, v in rows]
    schema = "vec_id long, embedding array<double>, label string, zone int, cluster int, dim int"
    checked(clustering.clustered(spark.createDataFrame(full, schema)).collect(), rows)
    checked(clustering.clustered(spark.createDataFrame(full[:9], schema)).collect(), rows[:9])
    assert clustering.clustered(spark.createDataFrame(full[:7], schema)).collect() == []
    assert clustering.clustered(spark.createDataFrame([], schema)).columns[:3] == ["vec_id", "cluster", "distance"]


def test_too_large_a_component_is_an_error(spark):
    table = spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit"):
        clustering.clustered(table)
