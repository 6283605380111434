"""Shards of near-equal bytes, or the fewest of a fixed capacity, by best-fit-decreasing bin packing.

Rows with equal texts form a group that is never split. Groups are taken by falling size; each enters
the bin with the least room that still holds it, found in a balanced tree of (room, bin).

The driver sees a bounded number of items: groups above a fraction of the total (there can be no more
of them than that fraction allows) one by one, all others in bundles by the hash of their text, a
bundle being one item. So every group is placed whole and no row or group passes through the driver.
"""

from __future__ import annotations

import random
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import written
from tidemark.plans.ordered import OrderedRows, Running

# Items a bin is filled with at least; the driver holds at most twice as many for each bin.
FINENESS = 1024
TOLERANCE = 1e-4


class RoomTree:
    """A treap of (room, bin): a binary search tree that random priorities keep balanced."""

    def __init__(self, seed: int = 1):
        self._root: list | None = None  # [key, priority, left, right]
        self._draw = random.Random(seed).random

    def add(self, room: int, bin_number: int) -> None:
        key = (room, bin_number)
        low, high = self._cut(self._root, key)
        self._root = self._joined(self._joined(low, [key, self._draw(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry with the least room of ``size`` or more."""
        node, found = self._root, None
        while node is not None:
            if node[0][0] >= size:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            low, rest = self._cut(self._root, found)
            _, high = self._cut(rest, (found[0], found[1] + 1))
            self._root = self._joined(low, high)
        return found

    def _cut(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Trees of the keys below ``key`` and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._cut(node[3], key)
            return node, high
        low, node[2] = self._cut(node[2], key)
        return low, node

    def _joined(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low if high is None else high
        if low[1] < high[1]:
            low[3] = self._joined(low[3], high)
            return low
        high[2] = self._joined(low, high[2])
        return high


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, bins numbered as they open; an item above the capacity gets its own."""
    tree, bins, out = RoomTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[i])
        if found is None:
            found, bins = (max(capacity, sizes[i]), bins), bins + 1
        out[i] = found[1]
        tree.add(found[0] - sizes[i], found[1])
    return out


def near_equal(sizes: list[int], count: int) -> list[int]:
    """Bins 0 to ``count`` - 1 with the least capacity that best-fit-decreasing needs for them.

    An item above an even share of what is left has a bin to itself.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, total, used = [0] * len(sizes), sum(sizes), 0
    while used < count - 1 and used < len(order) and sizes[order[used]] * (count - used) >= total:
        out[order[used]] = used
        total -= sizes[order[used]]
        used += 1
    rest = order[used:]
    if not rest:
        return out
    items, bins = [sizes[i] for i in rest], count - used
    low = max(-(-total // bins), items[0])
    steps = max(1, int(low * TOLERANCE))
    # Twice the even share is always enough.
    trial = bisect_left(
        range(low // steps + 2),
        True,
        key=lambda i: max(best_fit_decreasing(items, low + i * steps)) < bins,
    )
    for i, number in zip(rest, best_fit_decreasing(items, low + trial * steps), strict=True):
        out[i] = used + number
    return out


def shards(docs: DataFrame, count: int | None = None, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``.

    Either ``count`` shards of near-equal size or the fewest of ``capacity`` bytes. size is the text's
    bytes in UTF-8 plus one; a null text counts as empty. Slots number a shard's rows from 0 in order
    of doc_id. The law is ``bytes``, so grown_shard is null. Rows that repeat a doc_id are rows of
    their own; extra columns are ignored; an empty table gives an empty result.
    """
    if (count is None) == (capacity is None):
        raise ValueError("give either count or capacity")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("bigint"),
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    unit = max(1, (total // count if capacity is None else capacity) // FINENESS)
    bundles = max(1, total // unit)
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("size")), "shard-groups")
    item = F.when(F.col("size") <= unit, F.pmod("group", F.lit(bundles))).alias("bundle")
    items = (
        groups.select("size", F.when(F.col("size") > unit, F.col("group")).alias("group"), item)
        .groupBy("group", "bundle")
        .agg(F.sum("size").alias("size"))
        .orderBy("group", "bundle")
        .collect()
    )
    sizes = [row["size"] for row in items]
    bins = near_equal(sizes, count) if capacity is None else best_fit_decreasing(sizes, capacity)
    placed = [(row["group"], row["bundle"], number) for row, number in zip(items, bins, strict=True)]
    large = [(group, number) for group, _, number in placed if group is not None]
    small = [(bundle, number) for group, bundle, number in placed if group is None]
    # Both tables have at most twice FINENESS rows for each shard.
    own = F.broadcast(spark.createDataFrame(large, "group bigint, own int"))
    shared = F.broadcast(spark.createDataFrame(small, "bundle bigint, shared int"))
    assigned = (
        rows.join(own, "group", "left")
        .withColumn("bundle", F.pmod("group", F.lit(bundles)))
        .join(shared, "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"))
    )
    slotted = OrderedRows.of(assigned, ["doc_id", "size", "text_crc32"], ["shard"]).running(
        slot=Running("count", F.lit(1), before=True)
    )
    return slotted.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
