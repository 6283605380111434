"""Stored tables: layout, upserts, retention, lookups."""

import json
import os
from datetime import timedelta

import pytest
from helpers import at, naive
from pyspark.sql import functions as F

from tidemark.functions.times import Windows
from tidemark.schemas import FACT_EVENT, JOINED_EVENTS, WINDOW_RESULTS
from tidemark.sources import store as st

DAY = 86400


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path / "store"))


def joined(spark, *offsets):
    rows = [(f"e{i}", at(o), at(o + 1), f"u{i}", "{}", "t", 0, i, "gold", None) for i, o in enumerate(offsets)]
    schema = FACT_EVENT.simpleString()[len("struct<"):-1] + ",tier:string,country:string"
    return spark.createDataFrame(rows, schema)


def results(spark, *rows):
    """Rows of (id, start offset, version, count)."""
    full = [
        (i, at(s), at(s + 300), json.dumps({"count": float(n)}), n, v > 0, v, at(s + 300 + v), at(s + 300))
        for i, s, v, n in rows
    ]
    return spark.createDataFrame(full, WINDOW_RESULTS)


def test_empty_store_has_its_columns(store):
    assert store.joined_events().columns[:10] == JOINED_EVENTS.fieldNames()
    assert store.window_results().columns == WINDOW_RESULTS.fieldNames()
    assert {r.table_name: r.n_rows for r in store.stats().collect()} == {"joined_events": 0, "window_results": 0}


def test_extra_fields_go_to_attributes(spark, store):
    store.add_events(joined(spark, 0), 0)
    row = store.joined_events().first()
    assert json.loads(row.dimension_attrs_json) == {"tier": "gold", "country": None}
    assert (row.event_id, row.partition_id, row.offset_id) == ("e0", 0, 0)


def test_repeated_batch_replaces_itself(spark, store):
    for _ in range(2):
        store.add_events(joined(spark, 0, 5, DAY), 0)
    store.add_events(joined(spark, 7), 1)
    assert store.joined_events().count() == 4


def test_upsert_by_window_and_version(spark, store):
    store.add_windows(results(spark, ("w1", 0, 0, 10), ("w2", 0, 0, 1)), 0)
    store.add_windows(results(spark, ("w1", 0, 0, 15)), 1)
    store.add_windows(results(spark, ("w1", 0, 1, 16), ("w1", 0, 2, 17)), 2)
    expected = {("w1", 0): 15, ("w2", 0): 1, ("w1", 1): 16, ("w1", 2): 17}
    found = lambda: {(r.window_id, r.correction_version): r.event_count for r in store.window_results().collect()}
    assert found() == expected
    assert store.window_writes().count() == 5
    store.compact_windows()
    assert found() == expected
    assert store.window_writes().count() == 4
    store.add_windows(results(spark, ("w2", 0, 0, 2)), 3)
    assert found() == expected | {("w2", 0): 2}


def test_retention_is_strict(spark, store):
    cutoff = at(0)
    store.add_events(joined(spark, -10 * DAY, -1, 0, 1), 0)
    store.add_events(joined(spark, -10 * DAY + 5, 2 * DAY), 1)
    store.add_windows(results(spark, ("old", -400, 0, 1), ("edge", -300, 0, 1), ("new", 0, 0, 1)), 0)
    assert store.drop_before(cutoff) == 3 + 1
    assert sorted(r.event_time for r in store.joined_events().collect()) == [naive(at(o)) for o in (0, 1, 2 * DAY)]
    assert {r.window_id for r in store.window_results().collect()} == {"edge", "new"}
    old_day = (cutoff - timedelta(days=10)).date()
    left = os.listdir(f"{store.events_path}/event_date={old_day}") if os.path.exists(f"{store.events_path}/event_date={old_day}") else []
    assert not left
    assert store.drop_before(cutoff) == 0


def test_windows_at(spark, store):
    store.add_windows(
        results(spark, ("a", -150, 0, 1), ("a", -150, 1, 2), ("b", -300, 0, 3), ("c", 0, 0, 4), ("d", 1, 0, 5)), 0
    )
    found = {r.window_id: r.event_count for r in store.windows_at(at(0)).collect()}
    assert found == {"a": 2, "c": 4}


def test_windows_at_many(spark, store):
    store.add_windows(results(spark, ("a", -300, 0, 1), ("a", -300, 1, 2), ("c", 0, 0, 4)), 0)
    instants = spark.createDataFrame([(1, at(-1)), (2, at(0)), (3, at(299)), (4, at(300))], "n int, instant timestamp")
    found = st.windows_at_many(store.window_results(), instants, Windows(300, 300))
    assert {(r.n, r.window_id, r.event_count) for r in found.collect()} == {(1, "a", 2), (2, "c", 4), (3, "c", 4)}


def test_latest_and_expanded(spark, store):
    store.add_windows(results(spark, *[(f"w{i:03}", i * 10, 0, i) for i in range(150)]), 0)
    newest = [r.window_id for r in store.latest_windows().collect()]
    assert newest == [f"w{i:03}" for i in range(149, 49, -1)]
    row = st.expanded(store.window_results().filter("window_id = 'w007'")).first()
    assert row.aggregations == {"count": 7.0}
    assert st.metrics_of(store.window_results()).count() == 150


def test_lookup_reads_only_its_dates(spark, store):
    store.add_events(joined(spark, 0, DAY, 2 * DAY, 3 * DAY), 0)
    found = store.events_between(at(DAY), at(3 * DAY))
    assert {r.event_id for r in found.collect()} == {"e1", "e2"}
    assert {r.event_id for r in store.events_between(at(0), at(9 * DAY), ["e0", "e3"]).collect()} == {"e0", "e3"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(event_time)" in plan


def test_date_of_event_decides_folder(spark, store):
    store.add_events(joined(spark, 0, DAY), 0)
    days = {r.event_date.isoformat() for r in store.joined_events().collect()}
    assert days == {"2024-01-01", "2024-01-02"}
    assert store.joined_events().filter(F.col("event_date") == "2024-01-02").count() == 1


def scans(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]], plan


def test_only_needed_dates_are_read(spark, store):
    for day in range(5):
        store.add_windows(results(spark, (f"w{day}", day * DAY, 0, 1)), day)
        store.add_events(joined(spark, day * DAY), day)
    found = store.windows_at(at(2 * DAY + 10), 300)
    filters, plan = scans(found)
    assert [r.window_id for r in found.collect()] == ["w2"]
    assert all("window_date" in x for x in filters) and "window_start" in plan.split("PushedFilters")[1]
    store.register()
    day = at(3 * DAY).date()
    for text in (
        f"SELECT event_count FROM window_results WHERE window_date = DATE '{day}'",
        f"SELECT event_id FROM joined_events WHERE event_date = DATE '{day}'",
    ):
        rows = spark.sql(text)
        assert rows.count() == 1
        assert all("date" in x for x in scans(rows)[0])


def test_retention_drops_whole_dates(spark, store):
    for batch, day in enumerate((0, 0, 1, 2, 2)):
        store.add_events(joined(spark, day * DAY, day * DAY + 600), batch)
    assert store.drop_before(at(2 * DAY + 300)) == 8
    left = [d for d in os.listdir(store.events_path) if d.startswith("event_date")]
    assert left == [f"event_date={at(2 * DAY).date()}"]
    assert store.joined_events().count() == 2


def test_newest_results_read_few_dates(spark, store):
    """Thirty dates, of which the newest hundred results need two; a late correction of an old window counts."""
    for day in range(30):
        rows = [(f"d{day}w{i}", day * DAY + 300 * i, 0, i) for i in range(60)]
        store.add_windows(results(spark, *rows), day)
    plain = lambda limit: st.newest_results(store.window_results(), limit).collect()
    found = store.latest_windows()
    assert len({path.split("window_date=")[1][:10] for path in found.inputFiles()}) == 2
    assert found.collect() == plain(100)
    late = results(spark, ("d3w5", 3 * DAY + 1500, 1, 9)).withColumn("emitted_at", F.lit(at(40 * DAY)))
    store.add_windows(late, 30)
    found = store.latest_windows(5)
    assert found.collect() == plain(5) and found.first().window_id == "d3w5"
    assert len({path.split("window_date=")[1][:10] for path in found.inputFiles()}) <= 2
    assert store.latest_windows(5000).collect() == plain(5000)
    store.drop_before(at(28 * DAY))
    assert store.latest_windows(20).collect() == plain(20)


def test_newest_results_without_an_index(spark, store):
    """Dates that were stored before there was an index are read first, whatever the others tell."""
    store.add_windows(results(spark, ("a", 0, 0, 1)), 0)
    store.add_windows(results(spark, ("b", 5 * DAY, 0, 1)), 1)
    os.remove(f"{store.index_path}/batch-0.json")
    assert [r.window_id for r in store.latest_windows(1).collect()] == ["b"]
    assert [r.window_id for r in store.latest_windows(9).collect()] == ["b", "a"]


def test_ids_are_found_through_bloom_filters(spark, store):
    """An id that lies within the least and greatest of every file, but in one only."""
    for number in range(8):
        rows = spark.range(number, 8000, 8).selectExpr("cast(id as string) event_id", "id")
        rows = rows.selectExpr(
            "event_id", f"timestamp'2024-01-0{number + 1} 00:00:00' event_time", "timestamp'2024-01-09' ingest_time",
            "concat('u', id % 10) join_key", "'{}' payload_json", "'t' source_topic", "0 `partition`", "id `offset`",
        )
        store.add_events(rows, number)
    found = store.events_by("event_id", ["4243"])
    assert [(r.event_id, r.join_key) for r in found.collect()] == [("4243", "u3")]
    read = found._jdf.queryExecution().executedPlan()
    plan = read.executedPlan() if "Adaptive" in read.nodeName() else read
    scans = [plan]
    while scans[-1].children().size():
        scans.append(scans[-1].children().head())
    scan = next(x for x in reversed(scans) if "Scan" in x.nodeName())
    assert scan.metrics().get("numOutputRows").get().value() < 8000 / 4
    assert store.events_by("join_key", ["u3", "zzz"]).count() == 800
