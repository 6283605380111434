import random

import numpy as np
import pytest
from tests_llm_tools import prose, shingles_of, table, vocabulary

from tidemark.llm import near_dedup


def brute(rows):
    """Smallest id reachable over links of 75 % or more, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles_of(text))
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(
                x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]
            ):
                low, high = sorted((top(a), top(b)))
                group[high] = low
    return {i: top(i) for i in ids}


def edited(rng, text, words, rate):
    return " ".join(rng.choice(words) if rng.random() < rate else w for w in text.split())


def test_against_all_pairs(spark):
    rng = random.Random(5)
    words = vocabulary(rng, 300)
    rows = []
    for _ in range(40):
        base = prose(rng, words, rng.choice([1, 3, 5, 6, 9, 30, 80, 200]))
        rows += [base] + [edited(rng, base, words, rng.choice([0, 0.01, 0.03, 0.05])) for _ in range(4)]
    rows = list(enumerate(rng.sample(rows, len(rows))))
    found = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    expected = brute(rows)
    assert {i: found[i].component_id for i in expected} == expected
    assert all(found[i].n_shingles == len(shingles_of(t)) for i, t in rows)
    assert all(found[i].kept == (expected[i] == i) for i in expected)


def test_many_similar_that_are_not_linked(spark):
    """One large group of which most are no near-duplicates of each other, and pairs that are."""
    rng = random.Random(6)
    words = vocabulary(rng, 2000)
    base = prose(rng, words, 120)
    rows = [edited(rng, base, words, 0.06) for _ in range(250)]
    rows += [edited(rng, rows[i], words, 0.01) for i in range(0, 250, 5)]
    rows = list(enumerate(rng.sample(rows, len(rows))))
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert found == brute(rows)


def test_odd_rows(odd_docs, odd_rows):
    found = near_dedup.near_duplicates(odd_docs).collect()
    assert len(found) == len(odd_rows)
    expected = brute([x for x in odd_rows if x[0] is not None])
    for row in found:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
        else:
            assert row.component_id == expected[row.doc_id], row
    assert sorted(r.n_shingles for r in found) == sorted(len(shingles_of(t)) for _, t in odd_rows)
    kept = near_dedup.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    gone = {i for i, low in expected.items() if low != i}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(i) for i, _ in odd_rows if i not in gone
    )


def test_empty(no_docs):
    found = near_dedup.near_duplicates(no_docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and not found.count()
    assert not near_dedup.first_of_each(no_docs).count()


@pytest.mark.parametrize("share", [0.5, 0.75, 0.9])
def test_registers_estimate_similarity(share):
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        common = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        own = int(4000 * (1 - share) / share / 2)
        sets = [np.concatenate((common, rng.integers(0, 1 << 63, own, dtype=np.uint64))) for _ in range(2)]
        hashes = np.concatenate(sets) * np.uint64(2)
        offsets = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        sketch = near_dedup.registers(*near_dedup.distinct_sets(hashes, offsets))
        errors.append(near_dedup.estimated(sketch[:1], sketch[1:])[0] - share)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_registers_keep_zeros_and_mantissa():
    bits = near_dedup.VALUE_BITS
    values = np.array([(3 << bits) | (0b11 << (bits - 5)), (3 << bits) | (1 << (bits - 2))], np.uint64)
    found = near_dedup.registers(values, np.array([0, 2]))[0]
    assert np.flatnonzero(found).tolist() == [3]
    assert found[3] >> near_dedup.MANTISSA == 4  # three leading zeros and one
    assert found[3] & ((1 << near_dedup.MANTISSA) - 1) == 1 << (near_dedup.MANTISSA - 1)
    full = near_dedup.densified(found[None, :])[0]
    assert (full == found[3]).all()
