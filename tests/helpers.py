"""Fixed instants and small tables that several test modules share."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from tidemark.schemas import DIMENSION_CHANGE

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
BASE = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def at(seconds: float = 0) -> datetime:
    """An instant relative to the base time of the fixtures."""
    return BASE + timedelta(seconds=seconds)


def naive(moment: datetime | None) -> datetime | None:
    return None if moment is None else moment.astimezone(timezone.utc).replace(tzinfo=None)


def seconds(moment: datetime) -> float:
    """Seconds since 1970 of an instant without zone."""
    return (moment - naive(EPOCH)).total_seconds()


def log(spark, *changes):
    """Changes written as (key, op, version, attributes); the position is the sequence number."""
    rows = [
        (key, op, json.dumps(attrs) if attrs is not None else None, version, seq, at(seq))
        for seq, (key, op, version, attrs) in enumerate(changes)
    ]
    return spark.createDataFrame(rows, DIMENSION_CHANGE)


def up(key, version, **attrs):
    return (key, "upsert", version, attrs)


def gone(key):
    return (key, "delete", None, None)
