"""The standing dimension table against a fold of the whole change log."""

import random

import pytest
from helpers import at, gone, log, up
from pyspark.sql import functions as F

from tidemark.operators import dimension
from tidemark.schemas import DIMENSION_CHANGE
from tidemark.sources.dimension_table import DimensionTable, Manifest


def batches(spark, count=6, per=60, seed=3):
    """Random upserts and deletes, one key in a third of them; the position is the sequence number."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for _ in range(count):
        own = []
        for _ in range(per):
            key = "hot" if rng.random() < 0.33 else f"k{rng.randrange(25)}"
            change = gone(key) if rng.random() < 0.2 else up(key, rng.randrange(0, 9), n=seq)
            text = None if change[3] is None else f'{{"n":{seq}}}'
            own.append((key, change[1], text, change[2], seq, at(seq)))
            seq += 1
        rows.append(spark.createDataFrame(own, DIMENSION_CHANGE))
    return rows


def shown(table):
    return sorted(map(str, table.select(*sorted(table.columns)).collect()))


@pytest.mark.parametrize("max_deltas", [0, 1, 10])
def test_equals_replay_after_every_batch(spark, tmp_path, max_deltas):
    table = DimensionTable(spark, str(tmp_path), n_buckets=5, max_deltas=max_deltas)
    so_far = None
    for number, changes in enumerate(batches(spark)):
        table.apply(changes, number)
        so_far = changes if so_far is None else so_far.unionByName(changes)
        assert shown(table.table()) == shown(dimension.replay(so_far))
    assert len(table.manifest().deltas) == {0: 0, 1: 0, 10: 6}[max_deltas]
    wanted = spark.createDataFrame([("hot",), ("k3",), ("none",)], "dimension_key string")
    assert shown(table.lookup(wanted)) == shown(table.table().filter("dimension_key in ('hot', 'k3')"))


def test_changes_out_of_order_and_states_in_parts(spark, tmp_path):
    """A delete that comes before its upsert, across batches, counts by its sequence number."""
    whole = log(spark, up("a", 1, n=1), gone("a"), up("b", 0, n=1), gone("c"), up("c", 4, n=1))
    table = DimensionTable(spark, str(tmp_path), n_buckets=3, max_deltas=0)
    table.apply(whole.filter("seq in (1, 3)"), 0)
    assert table.table().count() == 0
    table.apply(whole.filter("seq in (0, 2, 4)"), 1)
    assert shown(table.table()) == shown(dimension.replay(whole))


def test_a_merge_reads_the_touched_buckets_only(spark, tmp_path):
    table = DimensionTable(spark, str(tmp_path), n_buckets=16, max_deltas=0)
    table.apply(log(spark, *[up(f"k{i}", 1, n=i) for i in range(400)]), 0)
    before = table.manifest()
    one = log(spark, up("k7", 2, n=9))
    bucket = one.select(table._bucket()).first()[0]
    parts = [before.buckets[bucket]]
    read = table._merged(parts).inputFiles()
    assert read and all(f"/bucket={bucket}/" in path for path in read)
    table.apply(one, 1)
    after = table.manifest()
    changed = {b for b in after.buckets if after.buckets[b] != before.buckets.get(b)}
    assert changed == {bucket} and len(after.buckets) == 16
    looked = table.lookup(spark.createDataFrame([("k7",)], "dimension_key string"))
    assert all(f"/bucket={bucket}/" in path for path in looked.inputFiles())
    assert [r.version for r in looked.collect()] == [2]


def test_repeated_batches_and_pinned_readers(spark, tmp_path):
    table = DimensionTable(spark, str(tmp_path), n_buckets=4, max_deltas=0)
    first, second = batches(spark, count=2)
    table.apply(first, 0)
    pinned = table.manifest()
    want = shown(table.table())
    table.apply(second, 1)
    now = shown(table.table())
    # Run again, as after a lost driver: with and without its manifest.
    table.apply(second, 1)
    assert shown(table.table()) == now and table.manifest().last_batch == 1
    assert shown(table.table(pinned)) == want
    assert DimensionTable(spark, str(tmp_path), n_buckets=4).version() == 1
    assert table.vacuum(keep=1) > 0 and shown(table.table()) == now
    assert table.vacuum(keep=1) == 0


def test_empty(spark, tmp_path):
    table = DimensionTable(spark, str(tmp_path), n_buckets=4)
    assert table.table().count() == 0 and table.version() == -1
    table.apply(spark.createDataFrame([], DIMENSION_CHANGE), 0)
    assert table.table().count() == 0 and table.version() == 0 and table.manifest().deltas == []
    assert Manifest.of(table.manifest().text()) == table.manifest()
    table.apply(log(spark, (None, "upsert", 1, {"a": 1})), 1)
    assert [r.dimension_key for r in table.table().collect()] == [None]
    table = DimensionTable(spark, f"{tmp_path}/merged", n_buckets=4, max_deltas=1)
    for number in range(3):
        table.apply(log(spark, (None, "upsert", number + 1, {"a": number})), number)
        assert [(r.dimension_key, r.version) for r in table.table().collect()] == [(None, number + 1)]


def test_base_stays_in_place_when_read(spark, tmp_path):
    """Only keys of the deltas are folded: the rest of the base is not shuffled."""
    table = DimensionTable(spark, str(tmp_path), n_buckets=4, max_deltas=3)
    table.apply(log(spark, *[up(f"k{i}", 1, n=i) for i in range(50)]), 0)
    table.apply(log(spark, up("k1", 2, n=0)), 1)
    plan = table.table()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert table.table().filter(F.col("version") == 2).count() == 1
