"""Left joins of facts with the dimension."""

import json
import random

import pytest
from helpers import at, gone, log, up
from pyspark.sql import functions as F

from tidemark.operators import dimension, enrich
from tidemark.schemas import FACT_EVENT


def facts(spark, *keys):
    rows = [(f"e{i}", at(i), at(i), key, "{}", "t", i % 3, i // 3) for i, key in enumerate(keys)]
    return spark.createDataFrame(rows, FACT_EVENT)


def people(spark):
    return dimension.replay(
        log(
            spark,
            up("u1", 1, name="Alice", region="US"),
            up("u2", 1, name="Bob", region="EU"),
            up("u3", 1, name="Charlie", region="APAC"),
        )
    )


def joined(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("event_time").collect()]


@pytest.mark.parametrize(
    ("keys", "expected"),
    [
        (["u1", "u2"], [("Alice", "US"), ("Bob", "EU")]),
        (["u1", "unknown"], [("Alice", "US"), (None, None)]),
        (["u1", "missing", "u2", "also"], [("Alice", "US"), (None, None), ("Bob", "EU"), (None, None)]),
        (["u1", "u1", "u1"], [("Alice", "US")] * 3),
    ],
)
def test_left_join(spark, keys, expected):
    assert joined(enrich.enrich(facts(spark, *keys), people(spark)), "name", "region") == expected


def test_row_count_is_kept(spark):
    frame = facts(spark, *[f"u{i % 5}" for i in range(100)])
    assert enrich.enrich(frame, people(spark)).count() == 100


def test_empty_dimension_gives_facts(spark):
    frame = facts(spark, "u1")
    result = enrich.enrich(frame, dimension.replay(log(spark, gone("x"))))
    assert result.columns == frame.columns and result.count() == 1


def test_update_and_delete_are_seen(spark):
    table = people(spark)
    changed = dimension.upsert(table, log(spark, up("u1", 2, name="Alice Updated", region="CA"), gone("u2")))
    assert joined(enrich.enrich(facts(spark, "u1", "u2"), changed), "name", "region") == [
        ("Alice Updated", "CA"),
        (None, None),
    ]


def test_attribute_types(spark):
    table = dimension.replay(
        log(spark, up("a", 1, n=1, x=1.5, b=True, m=1), up("c", 1, n=2, s="t", o={"k": 1}, m="two"))
    )
    assert [r.attribute for r in enrich.attribute_keys(table).collect()] == ["b", "m", "n", "o", "s", "x"]
    flat = {r.dimension_key: r for r in enrich.flatten_attributes(table).collect()}
    assert (flat["a"].n, flat["a"].x, flat["a"].b, flat["a"].m) == (1, 1.5, True, "1")
    assert (flat["c"].s, json.loads(flat["c"].o), flat["c"].x, flat["c"].m) == ("t", {"k": 1}, None, "two")


def test_bad_attributes_are_skipped(spark):
    table = dimension.replay(log(spark, up("a", 1, n=1))).withColumn("attributes_json", F.lit("oops"))
    assert enrich.attribute_keys(table).count() == 0
    assert enrich.flatten_attributes(table, {"n": "bigint"}).first().n is None


def test_name_clash(spark):
    table = dimension.replay(
        log(spark, up("u1", 1, source_topic="dim", tier="gold"), up("u2", 1, tier="free"))
    )
    frame = facts(spark, "u1", "u2", "u3")
    suffixed = enrich.enrich(frame, table)
    assert joined(suffixed, "source_topic", "source_topic_right", "tier") == [
        ("t", "dim", "gold"),
        ("t", None, "free"),
        ("t", None, None),
    ]
    # A matched row without the attribute keeps its own value; an unmatched row gets null.
    kept = enrich.enrich(frame, table, on_conflict="override", protected=["source_topic"])
    assert joined(kept, "source_topic", "source_topic_right") == [("t", "dim"), ("t", None), ("t", None)]
    replaced = enrich.enrich(frame, table, on_conflict="override")
    assert joined(replaced, "source_topic", "tier") == [("dim", "gold"), ("t", "free"), (None, None)]


def test_clash_of_types(spark):
    """A text attribute named like a number column counts as null where it is no number."""
    table = dimension.replay(log(spark, up("u1", 1, partition="text"), up("u2", 1, partition="7")))
    replaced = enrich.enrich(facts(spark, "u1", "u2", "u3"), table, on_conflict="override")
    assert replaced.schema["partition"].dataType == facts(spark, "u1").schema["partition"].dataType
    assert joined(replaced, "partition") == [(None,), (7,), (None,)]


def test_as_of_equals_sequential_run(spark):
    rng = random.Random(3)
    steps, changes, seen = [], [], {}
    floor, rows = {}, {}
    for position in range(2500):
        key = "hot" if rng.random() < 0.35 else f"k{rng.randrange(30)}"
        roll = rng.random()
        if roll < 0.25:
            version = rng.randrange(0, 60)
            changes.append((key, "upsert", json.dumps({"p": position}), version, position, at(position)))
            if version > floor.get(key, 0):
                floor[key], rows[key] = version, position
        elif roll < 0.35:
            changes.append((key, "delete", None, None, position, at(position)))
            rows.pop(key, None)
        else:
            steps.append((f"e{position}", at(position), at(position), key, "{}", "t", 0, position))
            seen[f"e{position}"] = rows.get(key)
    log_frame = spark.createDataFrame(changes, log(spark, up("x", 1)).schema)
    result = enrich.enrich_as_of(
        spark.createDataFrame(steps, FACT_EVENT), log_frame, F.col("seq"), F.col("offset")
    )
    found = {
        r.event_id: json.loads(r.attributes_json)["p"] if r.attributes_json else None
        for r in result.collect()
    }
    assert found == seen
