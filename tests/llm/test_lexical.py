"""Ranked search against scores computed one by one."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests_llm_tools import TABLE, prose, vocabulary

from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, best=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, text in items:
        if i is not None:
            asked[i].update(terms_of(text))
    out = set()
    for item, terms in asked.items():
        scores = []
        for doc, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms
                if c[t]
            )
            if doc is not None and score > 0:
                scores.append((-score, doc))
        out |= {(item, k + 1, doc, -score) for k, (score, doc) in enumerate(sorted(scores)[:best])}
    return out


def rows(found):
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()}


def frames(spark, docs, items, parts=3):
    full = [(i, t, "en", "s", 0) for i, t in docs]
    return (
        spark.createDataFrame(full, TABLE).repartition(parts),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def corpus(rng, count):
    """Texts over words of very unequal frequency, a third of them one and the same, passages of items in some."""
    own = vocabulary(rng, 300)
    skewed = [own[int(300 * rng.random() ** 3)] for _ in range(4000)]
    items = [(k, prose(rng, skewed, 20)) for k in range(12)]
    same = prose(rng, skewed, 60)
    docs = []
    for i in range(count):
        text = same if i % 3 == 0 else prose(rng, skewed, rng.randrange(1, 150))
        if i % 17 == 0:
            text += ". " + items[i % 12][1].upper() + "!"
        docs.append((i, text))
    return docs, items


@pytest.mark.parametrize(("parts", "bucket", "block"), [(1, 8, 1_000_000), (3, 64, 30), (5, 1024, 100)])
def test_equal_to_plain_scores(spark, parts, bucket, block):
    docs, items = corpus(random.Random(4), 400)
    found = lexical.ranked(*frames(spark, docs, items, parts), bucket_rows=bucket, block_terms=block)
    assert rows(found) == plain(docs, items)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_fewer_than_asked_for(spark):
    docs, items = [(1, "a b"), (2, "b c"), (3, "d")], [(7, "A c"), (8, "zz"), (9, ",;"), (7, "d d")]
    assert rows(lexical.ranked(*frames(spark, docs, items))) == plain(docs, items)
    assert rows(lexical.ranked(*frames(spark, docs, items), best=1)) == plain(docs, items, 1)


def test_buckets_and_coordinates_prune():
    rng = np.random.default_rng(2)
    size, count = 60, 3000
    docs = [np.unique(rng.integers(0, size, rng.integers(1, 12))) for _ in range(count)]
    impacts = [rng.integers(1, 1_000_000, len(x)) for x in docs]
    lengths = np.array([math.sqrt(float((x.astype(float) ** 2).sum())) for x in impacts])
    items = lexical.Items.of([np.arange(k, k + 9) for k in range(20)], rng.integers(0, 5000, size))
    search = lexical.Search(items, 10)
    order = np.argsort(-lengths, kind="stable")
    for first in range(0, count, 50):
        part = order[first : first + 50]
        owner = np.repeat(np.arange(len(part)), [len(docs[i]) for i in part])
        search.add(
            lexical.Bucket.of(
                part,
                lengths[part],
                owner,
                np.concatenate([docs[i] for i in part]),
                np.concatenate([impacts[i] for i in part]),
                size,
            )
        )
    assert search.rescored < 0.5 * search.tried < 0.5 * count * len(items.places)
    for k, (places, weights) in enumerate(zip(items.places, items.weights)):
        weight = dict(zip(places.tolist(), weights.tolist()))
        score = [
            (-sum(weight.get(t, 0) * v for t, v in zip(docs[i].tolist(), impacts[i].tolist())), i) for i in range(count)
        ]
        want = [(i, -s) for s, i in sorted(score)[:10] if s]
        assert list(zip(search.docs[k].tolist(), search.scores[k].tolist())) == want


def test_sizes_beyond_64_bits():
    n = np.array([5, 10**7], np.int64)
    assert lexical.scaled_sizes(n, 10**11, 10**13).tolist() == [10 + 90 * x * 10**11 // 10**13 for x in n.tolist()]


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    items = [(1, "one two"), (2, "日本語 TEXT ﬁ"), (3, None), (None, "one"), (4, ""), (5, "spam x"), (5, odd_rows[1][1])]
    table = spark.createDataFrame([(i, t, 5, 6) for i, t in items], "item_id long, text string, score long, rank int")
    # Rows that repeat a doc_id and a text are two documents with one row each among the best.
    found = lexical.ranked(odd_docs, table)
    assert rows(found) == plain(odd_rows, items)
    assert found.groupBy("item_id").agg({"rank": "max"}).count() == 3
    assert lexical.ranked(no_docs, table).collect() == []
    assert lexical.ranked(odd_docs, table.filter("false")).collect() == []
    assert lexical.ranked(no_docs, table.filter("false")).columns == ["item_id", "rank", "doc_id", "score"]
