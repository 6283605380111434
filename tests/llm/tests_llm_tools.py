"""Random texts and plain counterparts of the operators' inner definitions."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id long, `row` long, `key` string, band long, `group` int, size long, n_words int, spans string, part int"
)
TABLE = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(rng: random.Random, size: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(size)]


def prose(rng: random.Random, words: list[str], count: int) -> str:
    return " ".join(rng.choice(words) for _ in range(count))


def words_of(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORDS.findall(lowered)


def shingles_of(text: str | None) -> set[tuple[str, ...]]:
    found = words_of(text)
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def table(spark, rows: list[tuple]):
    """Documents of (doc_id, text), the other columns filled in."""
    full = [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, TABLE)
