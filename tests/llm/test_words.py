import pyarrow as pa
from tests_llm_tools import shingles_of, words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.words import chunks, shingles, words

TEXT = st.one_of(st.none(), st.text(alphabet="aAbB é日\t\n\v\x1c\U0001f600", max_size=60))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=12), st.integers(0, 3))
def test_words_and_shingles_as_by_pattern(texts, skip):
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    texts = texts[min(skip, len(texts)) :]
    seen: dict = {}
    at = 0
    for first, end, data, offsets in chunks(column):
        found = words(data, offsets)
        hashes, bounds = shingles(found)
        for i, text in enumerate(texts[first:end]):
            expected = words_of(text)
            assert found.offsets[i + 1] - found.offsets[i] == len(expected)
            for k, word in zip(range(found.offsets[i], found.offsets[i + 1]), expected):
                assert seen.setdefault(("word", word), found.hashes[k]) == found.hashes[k]
            own = hashes[bounds[i] : bounds[i + 1]]
            order = [tuple(expected[k : k + 5]) for k in range(len(expected) - 4)] or [tuple(expected)]
            for five, value in zip(order if expected else [], own, strict=True):
                assert seen.setdefault(five, value) == value
            assert len({int(x) for x in own}) == len(shingles_of(text))
        at = end
    assert at == len(texts)
    assert len(set(map(int, seen.values()))) == len(seen)
