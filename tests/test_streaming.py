"""Streaming jobs against batch-by-batch and whole-batch runs of the same events."""

import json
import random

import numpy as np
import pytest
from helpers import EPOCH, at, log, naive, seconds, up
from pyspark.sql import functions as F

from tidemark.functions.times import SECOND, Windows
from tidemark.operators import dimension
from tidemark.operators import windows as w
from tidemark.operators.corrections import latest
from tidemark.schemas import RAW_MESSAGE
from tidemark.sources import messages
from tidemark.streaming import state
from tidemark.streaming.jobs import HEARTBEAT, Flow

SHAPE = Windows(60, 20)
WIDE = Windows(60, 5)
LATENESS = 15


def raw_batch(spark, rows):
    return spark.createDataFrame(rows, RAW_MESSAGE)


def raw_rows(events):
    """Messages of (event offset, arrival offset, value, key)."""
    rows = []
    for i, (event, arrived, value, key) in enumerate(events):
        body = {"event_id": f"e{arrived}-{i}", "event_time": at(event).isoformat(), "join_key": key, "value": value}
        rows.append((json.dumps(body), "t", i % 3, i, at(arrived)))
    return rows


def some_batches(n=5, per=60, seed=8):
    rng = random.Random(seed)
    clock, out = 0, []
    for _ in range(n):
        batch = []
        for _ in range(per):
            clock += rng.choice([0, 1, 3, 6])
            late = rng.choice([0, 0, 2, 10, 40, 120])
            batch.append((clock - late, clock, rng.choice([1.0, 2.5, -3.0]), rng.choice(["u1", "u2", "u3"])))
        out.append(batch)
    return out


def model(batches, shape):
    """Window versions batch by batch: the watermark moves once per batch."""
    size, slide = shape.size_seconds, shape.slide_seconds
    mark, state, versions, out, dropped = None, {}, {}, {}, 0
    for batch in batches:
        touched = set()
        for event, _, value, _ in batch:
            t = (at(event) - EPOCH).total_seconds()
            accepted = mark is None or t >= mark - LATENESS
            dropped += not accepted
            starts = [s for s in range(int(t // slide * slide), int(t - size) - slide, -slide) if s <= t < s + size]
            for s in starts:
                closed = mark is not None and s + size <= mark
                if (closed and s in versions) or (accepted and not closed):
                    n, total = state.get(s, (0, 0.0))
                    state[s] = (n + 1, total + value)
                    if closed:
                        touched.add(s)
        for s in touched:
            versions[s] += 1
            out[s, versions[s]] = state[s]
        top = max((at(e[0]) - EPOCH).total_seconds() for e in batch) - LATENESS
        mark = top if mark is None else max(mark, top)
        for s in state:
            if s not in versions and s + size <= mark:
                versions[s] = 0
                out[s, 0] = state[s]
    return out, dropped


def flow_of(spark, root, shape=SHAPE, **options):
    table = dimension.replay(log(spark, up("u1", 1, tier="gold"), up("u2", 1, tier="free")))
    return Flow(
        spark, str(root), shape, ["value"], LATENESS, dimension=lambda _: table,
        attribute_types={"tier": "string"}, **options,
    )


def versions_of(flow):
    rows = flow.store.window_results().collect()
    return {
        (seconds(r.window_start), r.correction_version): (
            r.event_count, pytest.approx(json.loads(r.aggregations_json)["value_sum"])
        )
        for r in rows
    }


def test_flow_equals_model(spark, tmp_path):
    """Five landed batches, each its own run of the same job; one of them is run twice."""
    batches = some_batches()
    flow = flow_of(spark, tmp_path / "out", WIDE)
    assert WIDE.wide and not SHAPE.wide
    land = str(tmp_path / "land")
    bad = [("oops", "t", 0, 999, at(0)), ("[1]", "t", 0, 1000, at(0))]
    for number, batch in enumerate(batches):
        rows = raw_batch(spark, raw_rows(batch) + (bad if number == 1 else []))
        rows.write.mode("append").parquet(land)
        flow.start(messages.landed(spark, land, streaming=True)).awaitTermination()
    expected, dropped = model(batches, WIDE)
    assert len([key for key in expected if key[1] > 0]) > 10 and dropped > 10
    assert versions_of(flow) == expected

    n_events = sum(map(len, batches))
    assert flow.table("dead_letters").count() == 2
    assert flow.table("late_events").count() == dropped
    assert flow.store.joined_events().count() == n_events - dropped
    progress = flow.table("progress").agg(F.sum("n_accepted"), F.sum("n_dropped"), F.sum("n_dead")).first()
    assert list(progress) == [n_events - dropped, dropped, 2]
    tiers = {(r.join_key, json.loads(r.dimension_attrs_json)["tier"]) for r in flow.store.joined_events().collect()}
    assert tiers == {("u1", "gold"), ("u2", "free"), ("u3", None)}

    # A batch that is run again, as after a lost driver, changes nothing.
    flow.process(raw_batch(spark, raw_rows(batches[-1])), len(batches) - 1)
    assert versions_of(flow) == expected
    assert flow.store.joined_events().count() == n_events - dropped
    newest = {seconds(r.window_start): r.correction_version for r in latest(flow.store.window_results()).collect()}
    assert newest == {s: max(v for t, v in expected if t == s) for s, _ in expected}


def test_silence_moves_the_watermark(spark, tmp_path):
    flow = flow_of(spark, tmp_path / "out", idle_timeout_seconds=30)
    flow.process(raw_batch(spark, raw_rows([(0, 0, 1.0, "u1"), (5, 5, 2.0, "u1")])), 0)
    assert flow.store.window_results().count() == 0
    beat = lambda offset, number: raw_batch(spark, [(None, HEARTBEAT, 0, number, at(offset))])
    flow.process(beat(35, 0), 1)  # exactly the timeout: not yet
    assert flow.table("progress").agg(F.max("watermark_us")).first()[0] == (at(5 - LATENESS) - EPOCH).total_seconds() * 1e6
    flow.process(beat(36, 1), 2)
    assert flow.table("progress").agg(F.max("watermark_us")).first()[0] == (at(6) - EPOCH).total_seconds() * 1e6
    flow.process(beat(200, 2), 3)
    closed = {seconds(r.window_start): r.event_count for r in flow.store.window_results().collect()}
    base = (at(0) - EPOCH).total_seconds()
    assert closed == {base - 40: 2, base - 20: 2, base: 2}
    assert flow.table("dead_letters").count() == 0


def test_empty_first_batch(spark, tmp_path):
    flow = flow_of(spark, tmp_path / "out")
    flow.process(raw_batch(spark, [("oops", "t", 0, 0, at(0))]), 0)
    flow.process(raw_batch(spark, raw_rows([(0, 1, 1.0, "u1")])), 1)
    assert flow.store.joined_events().count() == 1 and flow.store.window_results().count() == 0


def test_dropped_events_stay_out_of_open_windows(spark, tmp_path):
    """An event behind the lateness does not count, though its window is still open."""
    flow = flow_of(spark, tmp_path / "out", Windows(3600, 3600))
    for number, (event, value) in enumerate([(0, 1.0), (300, 2.0), (100, 4.0), (4000, 8.0)]):
        flow.process(raw_batch(spark, raw_rows([(event, event, value, "u1")])), number)
    rows = flow.store.window_results().collect()
    assert [(r.correction_version, r.event_count, json.loads(r.aggregations_json)["value_sum"]) for r in rows] == [
        (0, 2, 3.0)
    ]


def test_open_windows(spark, tmp_path):
    """Partial results while windows are open, and none once the watermark has passed them."""
    flow = flow_of(spark, tmp_path / "out", Windows(3600, 1800))
    seen = []
    for number, (event, value) in enumerate([(0, 1.0), (300, 2.0), (100, 4.0), (2500, 8.0), (90_000, 16.0)]):
        flow.process(raw_batch(spark, raw_rows([(event, event, value, "u1")])), number)
        rows = flow.open_windows().collect()
        seen.append(sorted((seconds(r.window_start), r.event_count, r.value_sum) for r in rows))
    base = seconds(naive(at(0)))
    assert seen[1] == [(base - 1800, 2, 3.0), (base, 2, 3.0)]
    assert seen[2] == seen[1]  # dropped for its lateness
    assert seen[3] == [(base, 3, 11.0), (base + 1800, 1, 8.0)]
    assert [x[1:] for x in seen[4]] == [(1, 16.0), (1, 16.0)]


def test_lost_progress_is_an_error(spark, tmp_path):
    """Only the first batch may start without the watermark of the one before."""
    flow = flow_of(spark, tmp_path / "out")
    flow.process(raw_batch(spark, raw_rows([(0, 1, 1.0, "u1")])), 0)
    with pytest.raises(RuntimeError, match="progress"):
        flow.process(raw_batch(spark, raw_rows([(9, 9, 1.0, "u1")])), 2)


def test_odd_numbers_and_attributes_do_not_stop_the_flow(spark, tmp_path):
    table = dimension.replay(log(spark, up("u1", 1, partition="text", event_time="soon", tier="gold")))
    flow = Flow(spark, str(tmp_path / "out"), SHAPE, ["value"], LATENESS, dimension=lambda _: table)
    rows = raw_rows([(0, 1, 1.0, "u1")])
    for i, number in enumerate(["1e28", "12345678901234567890123456789", "-1e300", "1e400"]):
        rows.append((f'{{"event_time":{number},"join_key":"u1"}}', "t", 0, 100 + i, at(1)))
    flow.process(raw_batch(spark, rows), 0)
    assert {r.error for r in flow.table("dead_letters").collect()} == {"Invalid 'event_time' field"}
    stored = flow.store.joined_events().collect()
    assert [(r.partition_id, json.loads(r.dimension_attrs_json)) for r in stored] == [
        (0, {"event_time_right": "soon", "partition_right": "text", "tier": "gold"})
    ]


def test_found_fields_and_attributes(spark, tmp_path):
    """A field that first appears in the third batch is in first results and in corrections; numbers of the
    dimension count like those of the message; a new Flow object goes on where the last one stood."""
    table = dimension.replay(log(spark, up("u1", 1, price=10.0), up("u2", 1, price=2)))

    def flow():
        return Flow(
            spark, str(tmp_path / "out"), Windows(60, 60), None, LATENESS, dimension=lambda _: table,
            attribute_types={"price": "double"}, attribute_fields=["price"],
        )

    def message(number, event, key, **numbers):
        return (json.dumps({"event_time": at(event).isoformat(), "join_key": key, **numbers}), "t", 0, number, at(event))

    batches = [
        [message(0, 0, "u1", value=1), message(1, 10, "u3", value=2, text="x", flag=True)],
        [message(2, 90, "u2", value=4)],
        [message(3, 95, "u1", value=8, rare=5), message(4, 5, "u1", rare=7, nested={"a": 1})],
        [message(5, 400, "u1", value=16)],
    ]
    for number, batch in enumerate(batches):
        flow().process(raw_batch(spark, batch), number)
    rows = {
        (seconds(r.window_start) - seconds(naive(at(0))), r.correction_version): json.loads(r.aggregations_json)
        for r in flow().store.window_results().collect()
    }
    first = {"count": 2, "price_avg": 10, "price_max": 10, "price_min": 10, "price_sum": 10}
    first |= {"value_avg": 1.5, "value_max": 2, "value_min": 1, "value_sum": 3}
    second = first | {"count": 3, "price_sum": 20} | {f"rare_{part}": 7 for part in ("avg", "max", "min", "sum")}
    assert rows[0, 0] == first and rows[0, 1] == second
    assert rows[60, 0] == {
        "count": 2, "price_avg": 6, "price_max": 10, "price_min": 2, "price_sum": 12,
        "rare_avg": 5, "rare_max": 5, "rare_min": 5, "rare_sum": 5,
        "value_avg": 6, "value_max": 8, "value_min": 4, "value_sum": 12,
    }
    assert len(rows) == 3


def test_events_of_the_future_are_set_aside(spark, tmp_path):
    """A far date neither moves the watermark nor closes what is open."""
    flow = flow_of(spark, tmp_path / "out")
    far = ('{"event_time":253402300799,"join_key":"u1","value":1}', "t", 0, 77, at(1))
    near = raw_rows([(250, 1, 2.0, "u1")])
    flow.process(raw_batch(spark, [far, *near, *raw_rows([(0, 1, 1.0, "u1")])]), 0)
    flow.process(raw_batch(spark, raw_rows([(255, 255, 2.0, "u1")])), 1)
    assert [r.error for r in flow.table("dead_letters").collect()] == ["Field 'event_time' lies in the future"]
    assert flow.store.joined_events().count() == 3
    assert flow.table("progress").agg(F.max("watermark_us")).first()[0] == seconds(naive(at(255 - LATENESS))) * 1e6


def test_published_batches_are_taken_once(spark, tmp_path):
    """A batch that crashed after it was published publishes nothing more; windows may lag behind batches."""
    flow = flow_of(spark, tmp_path / "out", Windows(60, 60))
    batches = [[(0, 0, 1.0, "u1")], [(100, 100, 2.0, "u1")], [(5, 101, 4.0, "u1")], [(300, 300, 8.0, "u1")]]
    for number, batch in enumerate(batches):
        flow.ingest(raw_batch(spark, raw_rows(batch)), number)
        flow.ingest(raw_batch(spark, raw_rows(batch)), number)
    assert flow.store.window_results().count() == 0
    flow.settle()
    expected, _ = model(batches, Windows(60, 60))
    assert versions_of(flow) == expected and any(version == 1 for _, version in expected)
    emitted = {(seconds(r.window_start), r.correction_version): r.emitted_at for r in flow.store.window_results().collect()}
    base = seconds(naive(at(0)))
    assert emitted[base, 0] == naive(at(100)) and emitted[base, 1] == naive(at(101)) and emitted[base + 60, 0] == naive(at(300))
    flow.settle()
    assert versions_of(flow) == expected


@pytest.mark.parametrize(("size", "slide", "seed"), [(60, 60, 1), (60, 5, 2), (50, 20, 3), (60, 25, 4)])
def test_state_of_blocks(size, slide, seed):
    """The state of blocks, kept as bytes between batches, against windows worked on one by one."""
    shape = Windows(size, slide)
    rng = random.Random(seed)
    length = state.block_length(shape)
    blobs, marks, found, want, versions, open_now = {}, [None], {}, {}, {}, {}
    clock = 0
    for batch in range(12):
        before = marks[-1]
        rows = []
        for _ in range(25):
            clock += rng.choice([0, 2, 7])
            rows.append(((clock - rng.choice([0, 0, 5, 60, 200])) * SECOND, rng.choice([1.0, -2.5, 4.0])))
        touched = set()
        keyed = {}
        for us, value in rows:
            accepted = before is None or us >= before - 15 * SECOND
            pane = us // shape.pane * shape.pane
            first = (us - shape.size) // shape.slide * shape.slide + shape.slide
            for start in range(first, us // shape.slide * shape.slide + 1, shape.slide):
                closed = before is not None and start + shape.size <= before
                if (closed and start in versions) or (accepted and not closed):
                    n, total = open_now.get(start, (0, 0.0))
                    open_now[start] = (n + 1, total + value)
                    if closed:
                        touched.add(start)
            for block in {start // length * length for start in range(first, us // shape.slide * shape.slide + 1, shape.slide)}:
                keyed.setdefault(block, []).append((accepted, (pane, 1, value, value, value)))
        for start in touched:
            versions[start] += 1
            want[start, versions[start]] = open_now[start]
        after = max([us for us, _ in rows] + [0]) - 15 * SECOND
        marks.append(after if before is None else max(before, after))
        for start in open_now:
            if start not in versions and start + shape.size <= marks[-1]:
                versions[start] = 0
                want[start, 0] = open_now[start]
        for block in {*keyed, *blobs}:
            own = state._Block(shape, block, state.COUNT, *blobs.get(block, (None, None)))
            if block in keyed:
                values = np.array([row for _, row in keyed[block]], state._PANE)
                own.add(batch, before, np.array([a for a, _ in keyed[block]]), values)
            own.close(marks[-1])
            blobs[block] = own.panes.blob(), own.closed_blob()
            for start, _, step, version, n, total, _, _ in own.out:
                assert (step == -1) == (version == 0)
                found[start, version] = (n, total)
    assert {k: (n, pytest.approx(t)) for k, (n, t) in want.items()} == found
    assert any(version > 1 for _, version in found)


def test_panes_go_with_their_windows():
    """What a block keeps of panes is bounded by its open windows."""
    shape = Windows(300, 1)
    own = state._Block(shape, 0, state.COUNT, None, None)
    for second in range(0, 600):
        values = np.array([(second * SECOND, 1, 1.0, 1.0, 1.0)], state._PANE)
        own.add(second, (second - 1) * SECOND if second else None, np.array([True]), values)
        assert len(own.panes.rows) <= 302
    own.close(600 * SECOND)
    assert len(own.panes.rows) == 0 and len(own.closed) == 300 and own.next_end() is None


def test_batch_reports(spark, tmp_path):
    """Each batch's rows and times by Spark's own account, the join's share by the flow's."""
    flow = flow_of(spark, tmp_path / "out", Windows(60, 60), name="told")
    reports = flow.reports()
    land = str(tmp_path / "land")
    for number, batch in enumerate([[(0, 0, 1.0, "u1"), (1, 1, 2.0, "u2")], [(100, 100, 4.0, "u1")]]):
        raw_batch(spark, raw_rows(batch)).coalesce(1).write.mode("append").parquet(land)
        flow.start(messages.landed(spark, land, streaming=True)).awaitTermination()
    assert reports.wait()
    spark.streams.removeListener(reports)
    rows = {(r.query, r.batch_id): r for r in reports.table().collect()}
    assert [rows["told-ingest", i].n_rows for i in (0, 1)] == [2, 1]
    assert all(r.trigger_ms >= r.steps_ms["addBatch"] > 0 for r in rows.values() if r.n_rows)
    assert any(r.state_rows > 0 for (name, _), r in rows.items() if name == "told-windows")
    for r in flow.table("progress").collect():
        assert 0 < r.join_seconds < r.elapsed_seconds


def test_upkeep_while_it_runs(spark, tmp_path):
    """Results are folded and old ones deleted between batches; what is left is as without it."""
    flow = flow_of(spark, tmp_path / "out", Windows(3600, 3600), upkeep_batches=2, retention_days=1)
    days = [0, 1, 2, 3]
    for number, day in enumerate(days):
        rows = raw_rows([(day * 86_400 + k, day * 86_400 + k, 1.0, "u1") for k in (0, 10, 5000)])
        flow.process(raw_batch(spark, [*rows, ("oops", "t", 0, 999, at(day * 86_400))]), number)
    flow.upkeep()
    newest = 3 * 86_400 + 5000 - LATENESS
    kept = [r.event_time for r in flow.store.joined_events().collect()]
    assert sorted(kept) == sorted(
        naive(at(day * 86_400 + k)) for day in days for k in (0, 10, 5000) if day * 86_400 + k >= newest - 86_400
    )
    ends = {seconds(r.window_end) - seconds(naive(at(0))) for r in flow.store.window_results().collect()}
    assert ends == {3 * 86_400 + 3600, 2 * 86_400 + 7200}
    assert len(flow.store._dated_folders()) == len({day for _, day, _ in flow.store._dated_folders()})
    assert {r.batch_id for r in flow.table("progress").collect()} == {2, 3}
    assert flow.table("dead_letters").count() == 2
    # It goes on from there; the events of the third day are past their time by then.
    flow.process(raw_batch(spark, raw_rows([(4 * 86_400, 4 * 86_400, 1.0, "u1")])), 4)
    flow.upkeep()
    assert sorted(r.event_time for r in flow.store.joined_events().collect()) == [
        naive(at(x)) for x in (3 * 86_400, 3 * 86_400 + 10, 3 * 86_400 + 5000, 4 * 86_400)
    ]


def test_a_batch_of_one_file_is_decoded_by_many_tasks(spark, tmp_path):
    class Watched(Flow):
        def _decoded(self, batch):
            self.tasks = batch.select(F.spark_partition_id()).distinct().count()
            return super()._decoded(batch)

    rows = [(json.dumps({"event_id": f"e{i}", "join_key": "a", "event_time": 1000 + i}), "t", 0, i, at(i)) for i in range(200)]
    flow = Watched(spark, str(tmp_path / "out"), Windows(60, 60), ["value"])
    flow.ingest(spark.createDataFrame(rows, RAW_MESSAGE).coalesce(1), 0)
    assert flow.tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert flow.store.joined_events().count() == 200
