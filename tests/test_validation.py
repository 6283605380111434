"""Row rules, message conformance and field profiles."""

import json

import pytest
from helpers import at

from tidemark.functions import payload
from tidemark.functions.rules import checked, valid_rows, violation_counts
from tidemark.operators import validation


@pytest.mark.parametrize(
    ("row", "broken"),
    [
        ((at(0), "u", 0, 0), []),
        ((at(299), "u", 0, 0), []),
        ((at(300), "u", 0, 0), []),
        ((at(301), "u", 0, 0), ["event_time_in_future"]),
        ((at(0), "", 0, 0), ["empty_join_key"]),
        ((at(0), None, 0, 0), ["empty_join_key"]),
        ((at(0), "u", -1, 0), ["negative_partition"]),
        ((at(0), "u", 0, -1), ["negative_offset"]),
        ((at(900), "", -1, -1), ["event_time_in_future", "empty_join_key", "negative_partition", "negative_offset"]),
    ],
)
def test_event_rules(spark, row, broken):
    frame = spark.createDataFrame([row], "event_time timestamp, join_key string, partition int, offset long")
    assert checked(frame, validation.event_rules(at(0))).first().violations == broken


def test_dimension_rules(spark):
    rows = [("k", "{}", 1), ("", "{}", 1), ("k", "[1]", 1), ("k", "{}", 0), ("k", "oops", 2)]
    frame = spark.createDataFrame(rows, "dimension_key string, attributes_json string, version long")
    found = {tuple(r.violations) for r in checked(frame, validation.dimension_rules()).collect()}
    assert found == {(), ("empty_dimension_key",), ("attributes_not_an_object",), ("version_below_one",)}
    assert valid_rows(frame, validation.dimension_rules()).count() == 1


def test_window_rules(spark):
    schema = (
        "window_start timestamp, window_end timestamp, event_count long, correction_count int, "
        "is_closed boolean, last_emitted_at timestamp"
    )
    rows = [
        (at(0), at(10), 0, 0, False, None),
        (at(10), at(10), 0, 0, False, None),
        (at(0), at(10), -1, 0, False, None),
        (at(0), at(10), 0, -1, False, None),
        (at(0), at(10), 0, 0, True, None),
        (at(0), at(10), 0, 0, True, at(11)),
    ]
    frame = spark.createDataFrame(rows, schema)
    counts = {r.outcome: r.n_rows for r in violation_counts(frame, validation.window_rules()).collect()}
    assert counts == {
        "valid": 2,
        "start_not_before_end": 1,
        "negative_event_count": 1,
        "negative_correction_count": 1,
        "closed_without_emission": 1,
    }


GOOD = {"event_id": "e", "event_time": "t", "join_key": "k", "payload": {"a": 1}}


@pytest.mark.parametrize(
    ("body", "ok"),
    [
        (GOOD, True),
        (GOOD | {"extra": 1}, True),
        ({k: v for k, v in GOOD.items() if k != "join_key"}, False),
        (GOOD | {"join_key": ""}, False),
        (GOOD | {"join_key": 5}, False),
        (GOOD | {"payload": "text"}, False),
        (GOOD | {"event_id": None}, False),
        ([1], False),
    ],
)
def test_conformance(spark, body, ok):
    frame = spark.createDataFrame([(json.dumps(body),)], "value string")
    assert frame.select(validation.conforms(payload.body("value")).alias("ok")).first().ok is ok


def test_missing_fields(spark):
    rows = [(json.dumps(GOOD),), (json.dumps({"event_id": "e"}),), ("oops",)]
    frame = spark.createDataFrame(rows, "value string")
    found = {r.field: r.n_lacking for r in validation.missing_fields(frame, list(GOOD)).collect()}
    assert found == {"event_time": 1, "join_key": 1, "payload": 1}
    assert validation.missing_fields(frame.limit(1), list(GOOD)).count() == 0


def test_numbers_are_not_text(spark):
    text = '{"a": 5, "b": "5", "c": true, "d": null, "e": {"x": 1}, "f": 1.5, "g": [1], "h": 1e3}'
    frame = spark.createDataFrame([(1, text), (2, "{}"), (3, "oops")], "id long, payload_json string")
    found = {(r.id, r.field, r.value) for r in payload.numeric_fields(frame, ["id"]).collect()}
    assert found == {(1, "a", 5.0), (1, "f", 1.5), (1, "h", 1000.0)}
    wide = payload.with_numbers(frame, ["a", "b", "f"]).orderBy("id").first()
    assert (wide.a, wide.b, wide.f) == (5.0, None, 1.5)


def test_odd_field_names(spark):
    text = '{"a.b": 1, "it\'s": 2, "sp ace": 3, "q\\"q": 4}'
    frame = spark.createDataFrame([(text,)], "payload_json string")
    body = payload.body("payload_json")
    names = ["a.b", "it's", "sp ace", 'q"q']
    row = frame.select(*[payload.number(body, n).alias(f"c{i}") for i, n in enumerate(names)]).first()
    assert list(row) == [1.0, 2.0, 3.0, 4.0]


def test_profile(spark):
    rows = [('{"a": 1}',), ('{"a": "x", "b": 2}',), ("oops",)]
    frame = spark.createDataFrame(rows, "value string")
    found = {(r.field, r.json_type, r.n_messages, r.share) for r in validation.field_profile(frame).collect()}
    assert found == {("a", "BIGINT", 1, 0.5), ("a", "STRING", 1, 0.5), ("b", "BIGINT", 1, 0.5)}
