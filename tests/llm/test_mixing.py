"""Apportionment against a plain heap, and mixes whose spans, quotas and limits are counted one by one."""

import heapq
from collections import Counter, defaultdict
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_tools import table, words_of

from tidemark.llm import mixing


def plain_seats(wanted, limits, count):
    heap = [(-Fraction(t), i, 0) for i, t in enumerate(wanted) if t > 0 and limits[i]]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < count:
        _, i, q = heapq.heappop(heap)
        out.append(i)
        if q + 1 < limits[i]:
            heapq.heappush(heap, (-Fraction(wanted[i]) / (2 * q + 3), i, q + 1))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), max_size=8), st.integers(0, 120))
def test_seats_by_highest_quotient(sources, count):
    wanted, limits = [float(t) for t, _ in sources], [m for _, m in sources]
    assert mixing.seats(wanted, limits, count).tolist() == plain_seats(wanted, limits, count)


def plain_targets(sizes, weights):
    out = [None] * len(sizes)
    rest, free = Fraction(sum(sizes)), set(range(len(sizes)))
    while free:
        level = rest / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * level > 3 * sizes[i]}
        for i in over or free:
            out[i] = Fraction(3 * sizes[i]) if over else weights[i] * level
        if not over:
            break
        rest -= 3 * sum(sizes[i] for i in over)
        free -= over
    return [float(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.sampled_from([5, 2, 1])), min_size=1, max_size=12))
def test_targets_stop_at_three_times(sources):
    sizes, weights = [s for s, _ in sources], [w for _, w in sources]
    found = mixing.targets(sizes, weights)
    assert found == plain_targets(sizes, weights)
    assert all(t <= 3 * s for t, s in zip(found, sizes))
    assert abs(sum(found) - sum(sizes)) < 1e-6 * max(sum(sizes), 1)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 500), st.integers(0, 50))
def test_blocks_are_permuted(blocks, source):
    step, shift = mixing.step_and_shift(blocks, source, 7)
    assert sorted((step * b + shift) % blocks for b in range(blocks)) == list(range(blocks))


def corpus(spark, count=300):
    """A source with a third of all words, small ones, one of a single word, a missing and an empty one."""
    names = ["hot"] * 10 + ["b", "ä", "", None, "c", "c"]
    rows = [(k, " ".join(["w"] * (1 + 37 * k % 90)), "en", names[k % 16], 0) for k in range(count)]
    rows += [(1000, "one", "en", "tiny", 0), (1001, "", "en", "blank", 0), (1002, None, "en", "c", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_pieces_add_up_to_what_is_taken(spark):
    rows, docs = corpus(spark)
    own = {"seat_count": 400, "shards": 5}
    whole = {r.doc_id: r for r in mixing.mixed(docs, **own).collect()}
    parts = mixing.pieces(docs, **own).collect()
    length, places = Counter(), defaultdict(Counter)
    for p in parts:
        assert 0 <= p.start_word < p.end_word <= whole[p.doc_id].size and p.source == whole[p.doc_id].source
        length[p.doc_id] += p.end_word - p.start_word
        places[p.doc_id].update(range(p.start_word, p.end_word))
    assert {i: r.taken for i, r in whole.items()} == {i: length[i] for i in whole}
    # No word more than three times, and none three times before its neighbours are taken twice.
    assert all(max(c.values()) <= 3 for c in places.values())
    for r in whole.values():
        assert r.taken <= 3 * r.size and r.size == len(words_of(dict((x[0], x[1]) for x in rows)[r.doc_id]))
    # Shards hold the sources at their targets as nearly as a few blocks allow.
    block = -(-sum(r.size for r in whole.values()) // 400)
    by = Counter()
    for p in parts:
        by[p.shard, p.source] += p.end_word - p.start_word
    assert {s for s, _ in by} == set(range(5))
    for r in whole.values():
        for shard in range(5):
            assert abs(by[shard, r.source] - r.target / 5) <= 3 * block


def test_near_targets_and_the_same_again(spark):
    _, docs = corpus(spark)
    first = mixing.mixed(docs).collect()
    taken, goal = Counter(), {}
    for r in first:
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 2 for s in goal)
    again = mixing.mixed(docs.repartition(7, "text")).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert sorted(map(str, first)) != sorted(map(str, mixing.mixed(docs, seed=5).collect()))


def test_weights_by_name(spark):
    _, docs = corpus(spark)
    found = mixing.mixed(docs, weights={"hot": 1, None: 2}).collect()
    goal = {r.source: r.target for r in found}
    size = {r.source: r.source_size for r in found}
    assert goal[None] == 3 * size[None] and goal["b"] == 0
    assert sum(r.taken for r in found if r.source == "b") == 0


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = mixing.mixed(odd_docs).collect()
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted(
        (str(i), len(words_of(t))) for i, t in odd_rows
    )
    assert all(r.source is None and 0 <= r.taken <= 3 * r.size for r in found)
    assert sum(r.taken for r in found) == sum(r.size for r in found)
    assert mixing.mixed(no_docs).collect() == [] and mixing.pieces(no_docs).collect() == []
    blank = mixing.mixed(table(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2
