import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tests_llm_tools import table

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = [
    *"abe0 \n\t'!\r\v\f\x00\x1c\x1f\x85\xa0éß日한😀क्ا²Ⅷ",
    "the", "ing", "  ", "    ", "'s", "'ll", "...", "aaaa", " ", "　", "̀", "՘",
    "‍", "\U0001f468", "\U0010ffff", "\U00018d1a", "\U0001246f", "Ünïcödé", "12345",
]


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_as_the_library(own, library):
    rng = random.Random(4)
    for i in range(6000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))
        if i % 3 == 0:
            text = "".join(rng.choice("etaoinshr ") for _ in range(rng.randint(0, 80)))
        if i % 7 == 0:
            points = [rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)]) for _ in range(20)]
            text = "".join(map(chr, points))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_long_pieces(own, library):
    for text in ("a" * 20_000, "ab" * 9000, "etaoin" * 4000, " " * 30_000, "é" * 5000, "<|endoftext|>"):
        assert own.encode(text) == library.encode_ordinary(text)


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 5)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    own = bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for text in ("one two three four", "five six seven eight nine ten", "one two", "eleventh twelfth"):
        assert own.encode(text) == library.encode_ordinary(text)


def test_rows(odd_docs, odd_rows, no_docs, library):
    rows = bpe.encoded(odd_docs, PATH, public_tokenizers.PATTERN, keep_ids=True)
    expected = []
    for i, text in odd_rows:
        ids = library.encode_ordinary(text or "")
        joined = ",".join(map(str, ids)).encode()
        decoded = hashlib.sha256((text or "").encode()).hexdigest()
        expected.append((str(i), len(ids), hashlib.sha256(joined).hexdigest(), decoded))
    found = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows.collect()]
    assert sorted(found) == sorted(expected)
    back = bpe.decoded(rows.select("doc_id", "ids"), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in odd_rows)
    assert not bpe.encoded(no_docs, PATH, public_tokenizers.PATTERN).count()


def test_other_rows(spark, library):
    rows = bpe.encoded(table(spark, [(1, "Hello  world's 3rd")]), PATH, public_tokenizers.PATTERN)
    assert rows.collect()[0].n_tokens == len(library.encode_ordinary("Hello  world's 3rd"))
