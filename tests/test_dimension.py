"""The dimension table as the fold of its change log."""

import json
import random

import pytest
from helpers import at, gone, log, up
from pyspark.sql import functions as F

from tidemark.operators import dimension


def state(table):
    return {
        r.dimension_key: (r.version, json.loads(r.attributes_json), r.is_active)
        for r in table.collect()
    }


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ([up("u", 1, t="bronze"), up("u", 3, t="gold"), up("u", 2, t="silver")], {"u": (3, {"t": "gold"}, True)}),
        ([up("u", 1, n=1), up("u", 1, n=2)], {"u": (1, {"n": 1}, True)}),
        ([up("u", 1, n=1), gone("u"), up("u", 2, n=2)], {"u": (2, {"n": 2}, True)}),
        ([up("u", 1, n=1), gone("u"), up("u", 1, n=2)], {"u": (1, {"n": 1}, False)}),
        ([gone("u")], {}),
        ([gone("u"), up("u", 1, n=1)], {"u": (1, {"n": 1}, True)}),
        ([up("u", 0, n=1)], {}),
        ([up("u", 1, n=1), gone("u"), gone("u")], {"u": (1, {"n": 1}, False)}),
        ([up("a", 1), up("b", 5), gone("a")], {"a": (1, {}, False), "b": (5, {}, True)}),
    ],
)
def test_replay(spark, changes, expected):
    assert state(dimension.replay(log(spark, *changes))) == expected


def fold(changes):
    """One change at a time, as a single process would apply them."""
    rows, floor = {}, {}
    for key, op, version, attrs in changes:
        if op == "upsert" and version > floor.get(key, 0):
            rows[key] = (version, attrs, True)
            floor[key] = version
        elif op == "delete" and key in rows:
            rows[key] = (*rows[key][:2], False)
    return rows


def test_replay_equals_sequential_fold_with_hot_key(spark):
    rng = random.Random(7)
    changes = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(200)}"
        if rng.random() < 0.2:
            changes.append(gone(key))
        else:
            changes.append(up(key, rng.randrange(0, 40 if key != "hot" else 2000), i=i))
    shuffled = log(spark, *changes).repartition(8)
    assert state(dimension.replay(shuffled)) == fold(changes)


def test_upsert_continues_stored_table(spark):
    first = [up("a", 2, n=1), up("b", 1, n=1), gone("b"), up("c", 1, n=1)]
    then = [up("a", 2, n=9), up("b", 1, n=9), up("c", 2, n=9), gone("a"), up("d", 1, n=9)]
    stored = dimension.replay(log(spark, *first))
    assert state(dimension.upsert(stored, log(spark, *then))) == fold(first + then)


def test_rebuild_keeps_version_floor(spark):
    stored = dimension.replay(log(spark, up("a", 3, n=1), gone("a"), up("b", 1)))
    rebuilt = dimension.rebuild(stored)
    assert state(rebuilt) == state(stored)
    assert state(dimension.upsert(rebuilt, log(spark, up("a", 2, n=2))))["a"] == (3, {"n": 1}, False)


def test_load(spark):
    rows = [("u1", "Alice", None), ("", "nobody", None), (None, "nobody", None), ("u2", "Bob", 4), ("u3", "C", -2)]
    records = spark.createDataFrame(rows, "user_id string, name string, version int")
    table = dimension.loaded(dimension.load_changes(records, "user_id", F.lit(0), F.lit(at())))
    assert state(table) == {
        "u1": (1, {"name": "Alice", "version": None}, True),
        "u2": (4, {"name": "Bob", "version": 4}, True),
        "u3": (1, {"name": "C", "version": -2}, True),
    }


def test_version_must_be_an_integer(spark):
    records = spark.createDataFrame([("u", "7")], "user_id string, version string")
    table = dimension.loaded(dimension.load_changes(records, "user_id", F.lit(0), F.lit(at())))
    assert state(table) == {"u": (1, {"version": "7"}, True)}


def test_load_other_key_column(spark):
    records = spark.createDataFrame([("p1", "toys", 99.99)], "product_id string, category string, price double")
    table = dimension.loaded(dimension.load_changes(records, "product_id", F.lit(0), F.lit(at())))
    assert state(table)["p1"][1] == {"category": "toys", "price": 99.99}


def test_repeated_key_in_load_keeps_one_row(spark):
    records = spark.createDataFrame([("u", 1, 0), ("u", 1, 1), ("u", 2, 2), ("u", 2, 3)], "user_id string, version int, n int")
    table = dimension.loaded(dimension.load_changes(records, "user_id", F.col("n"), F.lit(at())))
    assert state(table) == {"u": (2, {"version": 2, "n": 3}, True)}


def test_delete_lookup_and_count(spark):
    table = dimension.replay(log(spark, up("a", 1, n=1), up("b", 1, n=2), up("c", 1, n=3)))
    keys = spark.createDataFrame([("b",), ("unknown",)], "dimension_key string")
    left = dimension.soft_delete(table, keys)
    assert {k: v[2] for k, v in state(left).items()} == {"a": True, "b": False, "c": True}
    assert dimension.active_count(left).first().row_count == 2
    asked = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "dimension_key string")
    found = sorted((r.dimension_key, r.attributes_json) for r in dimension.lookup(asked, left).collect() if r.attributes_json)
    assert found == [("a", '{"n": 1}'), ("a", '{"n": 1}')]
    assert dimension.lookup(asked, left).count() == 4
