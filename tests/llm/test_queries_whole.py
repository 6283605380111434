"""Registered queries on the smallest supplied tables against plain counterparts over all rows."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from tests_llm_tools import shingles_of, words_of

from tidemark.llm import bpe
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables not found")


@pytest.fixture(scope="module")
def texts():
    table = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(table.doc_id.tolist(), table.text.tolist()))


def rows_of(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_op1_every_repeat_of_fifty_words(spark, texts):
    first, need = {}, defaultdict(set)
    for i in sorted(texts):
        own = words_of(texts[i])
        for k in range(len(own) - 49):
            if first.setdefault(tuple(own[k : k + 50]), i) != i:
                need[i].update(range(k, k + 50))
    covered = defaultdict(set)
    for r in rows_of(spark, "op1_substring_dedup"):
        assert r.first_doc_id < r.doc_id and r.end_word - r.start_word >= 50
        covered[r.doc_id].update(range(r.start_word, r.end_word))
    assert need and all(len(need[i] - covered[i]) <= 2 for i in need)


def test_op2_batches(spark, texts):
    rows = rows_of(spark, "op2_packing")
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(words_of(t)) for i, t in texts.items()}
    by = defaultdict(list)
    for r in rows:
        by[r.bucket, r.batch].append(r)
    assert all(sum(r.padded_tokens for r in x) <= 1 << 16 or len(x) == 1 for x in by.values())


def test_op3_held_out(spark):
    truth = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").lang
    rows = [r for r in rows_of(spark, "op3_language") if r.held_out]
    right = sum(r.lang_pred == truth[r.doc_id] for r in rows)
    assert rows and right >= 0.97 * len(rows)


def test_op4_grades(spark, texts):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id")
    rows = {r.doc_id: r for r in rows_of(spark, "op4_quality")}
    assert set(rows) == set(texts)
    good = [i for i, x in labels.iterrows() if x.quality == 1 and x.toxic == 0]
    bad = [i for i, x in labels.iterrows() if x.quality == 0 or x.toxic == 1]
    assert sum(rows[i].kept for i in good) >= 0.97 * len(good)
    assert sum(rows[i].kept for i in bad) <= 0.05 * len(bad)


def test_op5_edits(spark, texts):
    ids = sorted(texts)
    for r in rows_of(spark, "op5_fingerprints"):
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles_of(text), shingles_of(edited)
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.2


def test_op6_components(spark, texts):
    sets = {i: shingles_of(t) for i, t in texts.items()}
    group = {i: i for i in texts}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sorted(texts):
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                group[high] = low
    rows = rows_of(spark, "op6_near_dedup")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {
        i: (len(sets[i]), top(i)) for i in texts
    }


def test_op7_archive(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    payloads = {i: (h or "").encode() for i, h in zip(pages.page_id.tolist(), pages.html.tolist())}
    first: dict = {}
    for i in sorted(payloads):
        first.setdefault(payloads[i], i)
    for r in rows_of(spark, "op7_warc"):
        data = payloads.pop(r.page_id)
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        other = None if first[data] == r.page_id else first[data]
        assert (r.record_type, r.refers_to) == ("revisit" if other is not None else "response", other)
    assert not payloads


def test_op9_shards(spark, texts):
    by, group = defaultdict(list), defaultdict(set)
    for r in rows_of(spark, "op9_sharding"):
        data = texts[r.doc_id].encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        by[r.shard].append(r)
        group[data].add(r.shard)
    assert set(by) == set(range(8)) and all(len(x) == 1 for x in group.values())
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r.size for r in x) for x in by.values()]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes)


def test_op10_tokens(spark, texts):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    rows = rows_of(spark, "op10_byte_bpe")
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_rows(spark, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0.5 * len(texts) < len(rows) < len(texts) and {r.doc_id for r in rows} < set(texts)
