"""Decoding of raw messages: good forms, damaged forms, nothing lost."""

import json

import pytest
from helpers import at
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.schemas import DEAD_LETTER, FACT_COLUMNS, RAW_MESSAGE
from tidemark.sources import messages


def raw(spark, *values):
    rows = [(v, "t", i % 3, i, at(i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RAW_MESSAGE)


def message(**fields):
    body = {"event_id": "e1", "event_time": "2024-01-01T12:00:00", "join_key": "u1"} | fields
    return json.dumps({k: v for k, v in body.items() if v is not ...})


def outcome(spark, value):
    row = ingest.decode(raw(spark, value)).select("*", F.unix_micros("event_time").alias("us")).first()
    return row


def test_valid_pair_keeps_schema(spark):
    frame = ingest.fact_events(ingest.decode(raw(spark, message(join_key="a"), message(join_key="b"))))
    assert frame.columns == FACT_COLUMNS
    assert [r.join_key for r in frame.orderBy("offset").collect()] == ["a", "b"]


def test_empty_input(spark):
    frame = ingest.fact_events(ingest.decode(spark.createDataFrame([], RAW_MESSAGE)))
    assert frame.columns == FACT_COLUMNS and frame.count() == 0


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        (1700000000, 1700000000_000000),
        (1700000000.25, 1700000000_250000),
        (1.5e9, 1500000000_000000),
        (0, 0),
        (-1.5, -1_500000),
        ("2024-01-01T12:00:00", 1704110400_000000),
        ("2024-01-01 12:00:00.5", 1704110400_500000),
        ("2024-01-01T12:00:00Z", 1704110400_000000),
        ("2024-01-01T12:00:00+02:00", 1704103200_000000),
        ("2024-01-01T12:00:00-0530", 1704130200_000000),
        ("2024-01-01T12:00:00.1234567", 1704110400_123456),
        ("2024-01-01", 1704067200_000000),
        ("20240101T120000", 1704110400_000000),
        ("2024-01-01T12", 1704110400_000000),
        ("2024-01-01T12:30", 1704112200_000000),
    ],
)
def test_event_time_forms(spark, value, expected):
    row = outcome(spark, message(event_time=value))
    assert row.error is None and row.us == expected


@pytest.mark.parametrize(
    ("value", "error"),
    [
        ("{broken", ingest.NOT_JSON),
        ("", ingest.NOT_JSON),
        (None, ingest.NOT_JSON),
        ("[1, 2]", ingest.NOT_OBJECT),
        ('"text"', ingest.NOT_OBJECT),
        ("null", ingest.NOT_OBJECT),
        (message(join_key=...), ingest.NO_KEY),
        (message(join_key=""), ingest.NO_KEY),
        (message(join_key=None), ingest.NO_KEY),
        (message(join_key=0), ingest.NO_KEY),
        (message(join_key=0.0), ingest.NO_KEY),
        (message(join_key=False), ingest.NO_KEY),
        (message(join_key={}), ingest.NO_KEY),
        (message(join_key={"a": 1}), ingest.BAD_KEY),
        (message(join_key=[1]), ingest.BAD_KEY),
        (message(event_time=...), ingest.NO_TIME),
        (message(event_time=None), ingest.NO_TIME),
        (message(event_time="soon"), ingest.BAD_TIME),
        (message(event_time="12:00:00"), ingest.BAD_TIME),
        (message(event_time="2024-02-30"), ingest.BAD_TIME),
        (message(event_time="2024"), ingest.BAD_TIME),
        (message(event_time=True), ingest.BAD_TIME),
        (message(event_time=1e300), ingest.BAD_TIME),
        (message(event_time=1e12), ingest.BAD_TIME),
        (message(event_time=[1]), ingest.BAD_TIME),
    ],
)
def test_dead_letters(spark, value, error):
    decoded = ingest.decode(raw(spark, value))
    dead = ingest.dead_letters(decoded)
    assert dead.schema.fieldNames() == DEAD_LETTER.fieldNames()
    row = dead.first()
    assert (row.original_message, row.error, row.source_topic) == (value, error, "t")
    assert ingest.fact_events(decoded).count() == 0


def test_mix_loses_nothing(spark):
    decoded = ingest.decode(raw(spark, "bad json", message(), "{invalid"))
    assert ingest.fact_events(decoded).count() == 1
    assert ingest.dead_letters(decoded).count() == 2


def test_ids_and_keys(spark):
    frame = ingest.fact_events(
        ingest.decode(
            raw(
                spark,
                message(event_id=...),
                message(event_id=None, join_key=7),
                message(event_id=12),
                '{"join_key": "a", "event_time": 1, "join_key": "b"}',
                '  {"join_key": "c", "event_time": 1}',
            )
        )
    )
    rows = [(r.event_id, r.join_key) for r in frame.orderBy("offset").collect()]
    assert rows == [("t-0-0", "u1"), ("t-1-1", "7"), ("12", "u1"), ("t-0-3", "b"), ("t-1-4", "c")]


def test_one_parse_per_message(spark):
    """The filter on the error column must not pull a second parse below it."""
    plan = ingest.fact_events(ingest.decode(raw(spark, message())))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parseJson(") == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(message(event_id=...) + "\n" + "oops\n")
    decoded = ingest.decode(messages.json_lines(spark, str(tmp_path), "lines"))
    first, again = (
        [r.event_id for r in ingest.fact_events(decoded).collect()] for _ in range(2)
    )
    assert first == again and len(first) == 1
    assert ingest.dead_letters(decoded).count() == 1
