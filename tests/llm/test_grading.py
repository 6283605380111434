import random

import numpy as np
import pyarrow as pa
from tests_llm_tools import prose, table, vocabulary

from tidemark.llm import grading
from tidemark.llm.words import chunks


def corpus(spark, size=600, seed=1):
    """Good prose, shouting (low quality), and prose with bad words (toxic)."""
    rng = random.Random(seed)
    words, bad = vocabulary(random.Random(0), 500), ["vexor", "vexed", "vexing", "grubble"]
    rows, labels = [], []
    for i in range(size):
        text, kind = prose(rng, words, rng.randint(20, 200)), rng.randint(0, 2)
        if kind == 1:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        if kind == 0:
            text = " ".join(w if rng.random() > 0.05 else f"{rng.choice(bad)}," for w in text.split())
            text += f" {bad[0]}"
        rows.append((i, text))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_grades(spark):
    docs, labels = corpus(spark, 1800)
    model = grading.learned(docs, labels.filter("doc_id % 3 <> 1"))
    assert model.thresholds[0] < model.thresholds[1]
    rows = (
        grading.graded(docs, model)
        .join(labels, "doc_id")
        .filter("doc_id % 3 = 1")
        .withColumn("grade", grading.grade())
        .collect()
    )
    good = [r.kept for r in rows if r.grade == 2]
    others = [r.kept for r in rows if r.grade < 2]
    assert np.mean(good) > 0.97 and np.mean(others) < 0.1
    means = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert means[0] < means[1] < means[2]
    for r in rows:
        assert 0 <= r.tail_good <= r.tail_toxic_free <= 1
        assert abs(r.expected_grade - r.tail_good - r.tail_toxic_free) < 1e-9


def test_features_by_hand():
    texts = pa.array(["Ab ab, x1", None, "", "!! ??"])
    (_, _, data, offsets) = next(chunks(texts))
    bounds, bucket, value = grading.features(data, offsets)
    own = [dict(zip(bucket[a:b].tolist(), (value[a:b] ** 2).tolist())) for a, b in zip(bounds, bounds[1:])]
    # Words ab (2 of 3) and x1, their stems, shapes Aa a, a0, and one repeated word of three.
    assert sorted(round(v, 3) for v in own[0].values()) == sorted(
        [0.667, 0.333, 0.667, 0.333, 0.333, 0.333, 0.333, 0.333]
    )
    assert not own[1] and not own[2]
    assert np.allclose(sorted(own[3].values()), [0.5, 0.5])


def test_gradient_matches_likelihood():
    """Fitting lowers the negative log likelihood of ordered data below that of the thresholds alone."""
    rng = np.random.default_rng(3)
    rows = 600
    x = rng.random(rows)
    grades = (x + 0.05 * rng.standard_normal(rows) > 0.33).astype(int) + (x > 0.66)
    grades = grades.clip(0, 2)
    bounds, bucket = np.arange(rows + 1), np.full(rows, 77)
    model = grading.fit(bounds, bucket, x, grades)
    tails = model.tails(bounds, bucket, x)
    edges = np.concatenate((np.ones((rows, 1)), tails, np.zeros((rows, 1))), axis=1)
    mass = edges[np.arange(rows), grades] - edges[np.arange(rows), grades + 1]
    alone = np.bincount(grades) / rows
    assert -np.log(mass).mean() < 0.5 * -np.log(alone[grades]).mean()
    assert model.weights[77] > 0


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    docs, labels = corpus(spark, 200)
    model = grading.learned(docs, labels)
    rows = grading.graded(odd_docs, model).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.expected_grade <= 2 for r in rows)
    empty = {r.tail_good for r in rows if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    assert not grading.graded(no_docs, model).count()
    kept = grading.selected(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in rows)
    assert not grading.selected(no_docs, model).count()


def test_nothing_to_learn(spark, no_docs):
    docs, labels = corpus(spark, 50)
    nulls = spark.createDataFrame([(1, None, 0), (None, 1, 1), (2, 1, None)], labels.schema)
    for model in (
        grading.learned(no_docs, labels),
        grading.learned(docs, labels.filter("1 = 0")),
        grading.learned(docs, nulls),
        grading.learned(docs, labels.filter("toxic = 1")),
    ):
        assert all(r.kept and r.tail_good == 1 for r in grading.graded(docs, model).collect())


def test_sample_is_bounded(spark):
    docs, labels = corpus(spark)
    assert len(grading.learned(docs, labels, sample=60).thresholds) == 2
