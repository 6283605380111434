import random
import zlib
from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_tools import prose, table, vocabulary, words_of

from tidemark.llm import packing, sharding


def plain_best_fit(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(rooms) if room >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(rooms)
            rooms.append(max(capacity, sizes[i]))
        rooms[b] -= sizes[i]
        out[i] = b
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(1, 80))
def test_tree_is_best_fit(sizes, capacity):
    assert sharding.best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80), st.integers(1, 9))
def test_near_equal(sizes, count):
    found = sharding.near_equal(sizes, count)
    assert set(found) <= set(range(count))
    total = [sum(s for s, b in zip(sizes, found) if b == k) for k in range(count)]
    # No packing beats the mean or the largest item; best fit is within a largest item of it.
    assert max(total) <= max(max(sizes), sum(sizes) / count + max(sizes))


def checked(found, rows, shards):
    texts = defaultdict(set)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    for r in found:
        texts[r.text_crc32, r.size].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(x) == 1 for x in texts.values())
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r.size for r in by[k]) for k in range(shards)]


def test_shards(spark):
    rng = random.Random(1)
    words = vocabulary(rng, 200)
    rows = [(i, prose(rng, words, rng.randint(0, 120))) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]
    total = checked(sharding.shards(table(spark, rows), count=8).collect(), rows, 8)
    assert max(total) - min(total) < 0.01 * sum(total)


def test_hot_group(spark):
    rows = [(i, "the same text of a third of all") for i in range(300)]
    rows += [(1000 + i, f"other text {i} and more of it") for i in range(600)]
    total = checked(sharding.shards(table(spark, rows), count=8).collect(), rows, 8)
    rest = sorted(total)[:-1]
    assert max(rest) - min(rest) < 0.02 * sum(rest)


def test_fixed_capacity(spark):
    rows = [(i, "x" * (i % 90)) for i in range(400)]
    found = sharding.shards(table(spark, rows), capacity=3000).collect()
    total = defaultdict(int)
    for r in found:
        total[r.shard] += r.size
    assert max(total.values()) <= 3000 and len(total) <= 1.05 * sum(total.values()) / 3000 + 1


def test_odd_rows_of_shards(odd_docs, odd_rows, no_docs):
    checked(sharding.shards(odd_docs, count=8).collect(), odd_rows, 8)
    assert not sharding.shards(no_docs, count=8).count()
    with pytest.raises(ValueError):
        sharding.shards(no_docs)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]

    def padded(ends):
        return sum(n * min(e for e in ends if e >= x) for x, n in histogram.items())

    found = packing.boundaries(lengths, counts, buckets)
    assert found == sorted(set(found)) and found[-1] == lengths[-1] and len(found) <= buckets
    size = min(buckets, len(lengths))
    best = min(padded((*c, lengths[-1])) for k in range(size) for c in combinations(lengths[:-1], k))
    assert padded(found) == best


def checked_batches(found, rows, budget):
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted(
        (str(i), len(words_of(t))) for i, t in rows
    )
    by, ends = defaultdict(list), {}
    for r in found:
        by[r.bucket, r.batch].append(r)
        assert r.n_tokens <= r.padded_tokens == ends.setdefault(r.bucket, r.padded_tokens)
    for (bucket, number), own in by.items():
        room = max(budget // ends[bucket], 1)
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= room
        later = [b for k, b in by if k == bucket and b > number]
        assert len(own) == room or not later
    for bucket in ends:
        numbers = sorted(b for k, b in by if k == bucket)
        assert numbers == list(range(len(numbers)))


def test_batches(spark):
    rng = random.Random(4)
    words = vocabulary(rng, 100)
    rows = [(i, prose(rng, words, int(rng.paretovariate(1) * 5) % 3000)) for i in range(600)]
    rows += [(2000 + i, "of one length") for i in range(300)]
    found = packing.packed(table(spark, rows), buckets=6, budget=2000).collect()
    checked_batches(found, rows, 2000)
    assert len({r.bucket for r in found}) == 6


def test_odd_rows_of_batches(odd_docs, odd_rows, no_docs):
    checked_batches(packing.packed(odd_docs, budget=500).collect(), odd_rows, 500)
    assert not packing.packed(no_docs).count()


def test_padded_to_the_longest_of_the_bucket(spark):
    rows = [(i, "w " * n) for i, n in enumerate((3, 257, 259, 1001, 1003, 5001))]
    longest, padded = defaultdict(int), {}
    for r in packing.packed(table(spark, rows), buckets=3).collect():
        longest[r.bucket] = max(longest[r.bucket], r.n_tokens)
        padded[r.bucket] = r.padded_tokens
    assert padded == longest and max(padded.values()) == 5001


@pytest.mark.parametrize("seed", range(4))
def test_least_padding_by_real_lengths(spark, seed):
    """Padding as little as the best of all choices of boundaries among the lengths that occur."""
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(200, 6000), 11))
    rows = [(i, "w " * rng.choice(lengths)) for i in range(120)]
    found = packing.packed(table(spark, rows), buckets=4).collect()
    counts = defaultdict(int)
    for r in found:
        counts[packing.np.searchsorted(lengths, r.n_tokens)] += 1
    there = [lengths[k] for k in sorted(counts)]
    n = {lengths[k]: c for k, c in counts.items()}
    best = min(
        sum(c * min(e for e in (*ends, there[-1]) if e >= x) for x, c in n.items())
        for k in range(4)
        for ends in combinations(there[:-1], k)
    )
    assert sum(r.padded_tokens for r in found) <= best * (1 + 1 / 128)
    cells = {int(r.g) for r in spark.createDataFrame([(x,) for x in there], "x long").select(packing.grid_length(packing.F.col("x")).alias("g")).collect()}
    if len(cells) == len(there):
        assert sum(r.padded_tokens for r in found) == best


def test_grid(spark):
    rows = spark.range(0, 200_000, 7).selectExpr("id").withColumn("g", packing.grid_length(packing.F.col("id")))
    found = rows.toPandas()
    assert (found.g >= found.id).all() and (found.g <= found.id.clip(1) * (1 + 1 / 128) + 1).all()
    assert (found.g[found.id.between(1, 256)] == found.id[found.id.between(1, 256)]).all()
    assert found.g.nunique() < 2000
