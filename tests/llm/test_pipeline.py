import random

import corpus_pipeline
import pytest
from tests_llm_tools import prose, shingles_of, table, vocabulary, words_of

from tidemark.llm.queries import QUERIES


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "language id", "minhash near-dedup", "substring dedup", "packing",
    ]


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Good prose with copies, shared passages, shouting and bad words; labels for two thirds."""
    rng = random.Random(7)
    words = vocabulary(rng, 600)
    shared = prose(rng, words, 70)
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        text = prose(rng, words, rng.randint(40, 160))
        if kind == 1:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        if kind == 2:
            text = " ".join(w if rng.random() > 0.1 else "vexor" for w in text.split()) + " vexor"
        if i % 20 == 0:
            text += "\n" + shared
        rows.append((i, text))
        if i % 3:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 80, 4)]
    rows += [(2000, "12 34 56"), (2001, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = table(spark, rows)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(rows), shared


def test_run(spark, corpus):
    path, texts, shared = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns, name
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    good = {i for i in texts if i < 1000 and i % 4 in (0, 3)}
    first = left["quality classifier"]
    assert len(good - set(first)) <= 6 and len([i for i in first if i < 1000 and i % 4 in (1, 2)]) <= 10
    assert not {2000, 2001} & set(left["language id"])
    single = left["minhash near-dedup"]
    assert not [i for i in single if 1000 <= i < 2000]
    sets = [shingles_of(t) for t in single.values()]
    assert len({frozenset(x) for x in sets}) == len(sets)
    last = left["substring dedup"]
    assert sum(shared in t for t in last.values()) == 1
    assert {i for i, t in last.items() if t != texts[i]} <= {i for i in texts if i % 20 == 0}
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(result) == set(last)
    assert all(result[i].n_tokens == len(words_of(t)) for i, t in last.items())


def test_odd_rows(spark, corpus, odd_docs, no_docs):
    path, _, _ = corpus
    for docs in (odd_docs, no_docs):
        start = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == start
        corpus_pipeline.batches(spark, docs, path).count()
