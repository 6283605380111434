"""The live as-of join against a sequential run over both logs."""

import random
from datetime import timedelta

import pandas as pd
from helpers import EPOCH, at

from tidemark.schemas import DIMENSION_CHANGE, FACT_EVENT
from tidemark.streaming import state, temporal

FACTS = FACT_EVENT.fieldNames()


def moments(count, seed):
    """(second, fact or change) in order; most are of one key."""
    rng = random.Random(seed)
    out = []
    for number in range(count):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", "none"])
        second = number // 3
        if rng.random() < 0.5:
            out.append((second, ("fact", key)))
        elif key != "none":
            out.append((second, (rng.choice(["upsert", "upsert", "delete"]), key, rng.randrange(0, 6))))
    return out


def expected(rows):
    """Changes at a fact's own second count."""
    changes = [(second, seq, *row) for seq, (second, row) in enumerate(rows) if row[0] != "fact"]
    out = {}
    for number, (second, row) in enumerate(rows):
        if row[0] != "fact":
            continue
        winner, deleted = None, None
        for at_second, seq, op, key, version in changes:
            if key == row[1] and at_second <= second:
                if op == "delete":
                    deleted = seq
                elif version > 0 and (winner is None or version > winner[0]):
                    winner = (version, seq)
        live = winner is not None and (deleted is None or deleted < winner[1])
        out[f"e{number}"] = (winner[0], f'{{"n":{winner[1]}}}') if live else (None, None)
    return out


def test_equals_sequential_run(spark, tmp_path):
    state.set_state_store(spark)
    rows = moments(240, 7)
    paths = {name: str(tmp_path / name) for name in ("facts", "changes")}
    schemas = {"facts": FACT_EVENT, "changes": DIMENSION_CHANGE}
    found = {}

    def run():
        streams = [spark.readStream.schema(schemas[name]).parquet(paths[name]) for name in ("facts", "changes")]
        joined = temporal.enrich_as_of(*streams, "event_time", "updated_at", "2 seconds", buckets=3, salts=2)

        def sink(batch, _):
            for r in batch.collect():
                assert r.event_id not in found
                found[r.event_id] = (r.version, r.attributes_json)

        query = joined.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination()

    def land(part, last=None):
        facts, changes = [], []
        for number, (second, row) in part:
            moment = EPOCH + timedelta(seconds=1000 + second)
            if row[0] == "fact":
                facts.append((f"e{number}", moment, at(number), row[1], "{}", "t", 0, number))
            else:
                text = None if row[0] == "delete" else f'{{"n":{number}}}'
                changes.append((row[1], row[0], text, row[2], number, moment))
        if last is not None:
            moment = EPOCH + timedelta(seconds=1000 + last)
            facts.append(("end", moment, at(0), "end", "{}", "t", 0, 10**6))
            changes.append(("end", "upsert", "{}", 1, 10**6, moment))
        for name, own in (("facts", facts), ("changes", changes)):
            spark.createDataFrame(own, schemas[name]).coalesce(1).write.mode("append").parquet(paths[name])

    numbered = list(enumerate(rows))
    rng = random.Random(1)
    for first in range(0, 240, 80):
        part = numbered[first : first + 80]
        # Out of order by up to two seconds, within a batch and across.
        rng.shuffle(part)
        land(part)
        run()
        assert not [i for i in found if int(i[1:]) >= first + 80]
    waiting = len(expected(rows)) - len(found)
    assert waiting > 0  # the last moments wait for the watermark
    land([], last=1000)
    run()
    found.pop("end", None)
    want = expected(rows)
    assert {k: found.get(k) for k in want} == want


class Handle:
    """A state in memory that counts how often it is asked."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def registerTimer(self, at):
        self.timers.append(at)

    def getMapState(self, name, key_schema, value_schema):
        return Table(self)


class Table(dict):
    def __init__(self, handle):
        self.handle = handle

    def __getattribute__(self, name):
        if name in ("containsKey", "getValue", "updateValue", "removeKey"):
            self.handle.calls += 1
        return super().__getattribute__(name)

    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


class Watermark:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: at


def test_state_is_asked_by_parts_not_by_keys():
    """5,000 keys, each with a change at 10, a fact at 20 and a later change, taken by two watermarks."""
    handle, job = Handle(), temporal.AsOf()
    job.init(handle)
    number = range(5000)
    frames = [
        pd.DataFrame(
            {
                "bucket": 0, "salt": 0, "part": [i % temporal.PARTS for i in number], "key": [f"k{i}" for i in number],
                "at": at, "side": side, "version": version, "seq": seq, "body": [f"{at}-{i}" for i in number],
            }
        )
        for at, side, version, seq in ((20, 2, None, None), (30, 0, 2, 7), (10, 0, 1, 5))
    ]
    assert [len(x) for x in job.handleInputRows((0, 0), iter(frames), None)] == [0]
    assert handle.timers == [11]
    first = pd.concat(job.handleExpiredTimer((0, 0), Watermark(21), None))
    assert handle.timers[-1] == 31
    want = [(f"20-{i}", f"10-{i}", 1) for i in number]
    assert sorted(first.itertuples(index=False, name=None)) == sorted(want)
    assert len(pd.concat(job.handleExpiredTimer((0, 0), Watermark(31), None))) == 0
    frame = frames[0].assign(at=40)
    list(job.handleInputRows((0, 0), iter([frame]), None))
    last = pd.concat(job.handleExpiredTimer((0, 0), Watermark(50), None))
    assert set(zip(last["attributes_json"], last["version"])) == {(f"30-{i}", 2) for i in number}
    assert handle.calls <= 20 * temporal.PARTS
