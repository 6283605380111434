import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language

TABLE = "doc_id long, text string, lang string"
LETTERS = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "дежзийкл"}


def corpus(spark, per_language=60):
    rng = random.Random(8)
    rows = []
    for lang, letters in LETTERS.items():
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(200)]
        rows += [(lang, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for _ in range(per_language)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], TABLE)


def plain_grams(text):
    """N-grams of each word with a blank at either end, the blank counted once between words."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found = Counter()
    for word in words:
        padded = f" {word} "
        found.update(word)
        found.update(padded[i : i + 2] for i in range(len(padded) - 1))
        found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return found


def code(gram):
    return sum((1 if c == " " else ord(c) + 2) << (21 * i) for i, c in enumerate(gram))


def test_grams_and_ranks():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aBcé日 .,1\n") for _ in range(rng.randint(0, 40)))
        expected = {code(k): n for k, n in plain_grams(text).items()}
        found, counts = np.unique(language.grams(text), return_counts=True)
        assert dict(zip(found.tolist(), counts.tolist())) == expected, repr(text)
        order = sorted(expected, key=lambda k: (-expected[k], k))
        assert language.ranked(text).tolist() == order[: language.LENGTH]


def test_nearest_by_hand():
    lists = {"x": [code("a"), code("b")], "y": [code("b"), code("a"), code("c")]}
    profiles = language.Profiles(lists)
    own = language.ranked("b b a")
    total = {}
    for name, ranks in lists.items():
        total[name] = sum(
            abs(i - ranks.index(g)) if g in ranks else language.LENGTH for i, g in enumerate(own.tolist())
        )
    name, score = profiles.nearest("b b a")
    assert name == min(sorted(total), key=total.get)
    assert abs(score - (1 - total[name] / (language.LENGTH * len(own)))) < 1e-12


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    rows = {r.doc_id: r for r in language.identified(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = corpus(spark)
    changed = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(map(str, language.identified(x).collect())) for x in (docs, changed))
    assert a == b


def test_sample_is_bounded(spark):
    docs = corpus(spark, 100)
    assert language.learned(docs, sample=10).languages == sorted(LETTERS)


def test_odd_rows(odd_docs, odd_rows, no_docs, spark):
    profiles = language.learned(corpus(spark))
    rows = language.predicted(odd_docs, profiles).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    unknown = sorted(str(r.doc_id) for r in rows if r.lang_pred == language.UNKNOWN)
    assert unknown == sorted(str(i) for i, t in odd_rows if not any(c.isalpha() for c in t or ""))
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert {r.lang_pred for r in language.identified(odd_docs).collect()} == {language.UNKNOWN}
    assert not language.identified(no_docs).count()
    kept = language.in_language(odd_docs, profiles, 0.0)
    assert kept.columns == odd_docs.columns
    # One text is of a letter that no profile has.
    assert kept.count() == len(odd_rows) - len(unknown) - 1
    assert not language.in_language(no_docs, profiles).count()


def test_foreign_text_is_rejected(spark):
    profiles = language.learned(corpus(spark))
    docs = spark.createDataFrame([(1, "щчцх щчцх фтсщ", None), (2, vocab(), None)], TABLE)
    assert [r.doc_id for r in language.in_language(docs, profiles).collect()] == [2]


def vocab():
    rng = random.Random(2)
    return " ".join("".join(rng.choice(LETTERS["aa"]) for _ in range(5)) for _ in range(50))


