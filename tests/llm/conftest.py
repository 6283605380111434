from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tests_llm_tools import SCHEMA, TABLE, prose, vocabulary  # noqa: E402

from tidemark.llm.registry import configured  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    return configured(spark)


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows and ids, ties, strange signs and a very long text."""
    rng = random.Random(3)
    words = vocabulary(rng, 400)
    long = prose(rng, words, 120_000)
    same = prose(rng, words, 80)
    return [
        (None, None),
        (None, same),
        (1, None),
        (2, ""),
        (3, " \t\n\v\f\r "),
        (4, same),
        (5, same),
        (5, same),
        (6, same.upper()),
        (7, "one"),
        (8, "one"),
        (9, "one two three four"),
        (10, "日本語 text ﬁ \U0001f600 \x00 \x1c ' ; -- %s {} <a>&amp;"),
        (11, long),
        (12, long + " end"),
        (13, "spam " * 500),
        (14, "x" * 50_000),
        (-15, prose(rng, words, 60) + "\n" + same),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use inside, most of them null."""
    full = [(i, t, None, None, None, i, 7, "k", None, 1, None, None, "s", 0) for i, t in odd_rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], TABLE)
