"""Language of a text by rank-order profiles of character n-grams.

A profile lists a language's 300 most frequent n-grams (one to three letters, a blank at either end of a
word) by falling frequency. A text's own list is compared with each profile: every n-gram adds the
distance between its two ranks, or the list's length if the profile lacks it. The nearest profile
names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTH = 300
# Texts of each language that the profiles are learned from, about; all where there are fewer.
SAMPLE = 3000
UNKNOWN = "und"
# In the pipeline: of the largest distance, how much must be missing for a text to count as language.
MIN_SCORE = 0.3

_BITS = 21  # a code point, 1 for a blank, 0 for none


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    surrogates = range(0xD800, 0xE000)
    return np.array([chr(c).isalpha() and c not in surrogates for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Code of each n-gram of a text, lower-cased: its places in 21 bits each, the first one lowest."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    # One blank for each run of other characters, and one at either end.
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    keep[-1] = letter[-1]
    places = np.where(letter, points.astype(np.int64) + 2, 1)[keep]
    places = np.concatenate(([1], places[int(places[0] == 1) :], [1]))
    first, second = places[:-1], places[1:]
    pairs = first | (second << _BITS)
    middle = places[1:-1] != 1
    triples = (pairs[:-1] | (places[2:] << (2 * _BITS)))[middle]
    return np.concatenate((places[places != 1], pairs, triples))


def ranked(text: str) -> np.ndarray:
    """A text's most frequent n-grams, by falling count; of equals the lower code comes first."""
    found, counts = np.unique(grams(text), return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:LENGTH]]


class Profiles:
    """Rank-order profiles of several languages."""

    def __init__(self, lists: dict[str, list[int]]):
        self.languages = sorted(lists)
        self.codes = np.unique(np.array([c for x in lists.values() for c in x], np.int64))
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), -1, np.int32)
        for row, language in enumerate(self.languages):
            at = np.searchsorted(self.codes, np.array(lists[language], np.int64))
            self.ranks[row, at] = np.arange(len(at))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and score: one less the share of the largest possible distance."""
        own = ranked(text) if text else np.zeros(0, np.int64)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == own
        ranks = self.ranks[:, np.where(known, at, len(self.codes))]
        apart = np.where(ranks < 0, LENGTH, np.abs(ranks - np.arange(len(own))))
        total = apart.sum(axis=1)
        best = int(np.argmin(total))
        return self.languages[best], 1 - float(total[best]) / (LENGTH * len(own))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: dict[str, list[np.ndarray]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(language, []).append(grams(text))
        for language, parts in texts.items():
            codes, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                ["lang", "code", "n"],
            )


def held_out() -> Column:
    """Whether a document is kept from learning, by its id alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned(labelled: DataFrame, sample: int = SAMPLE) -> Profiles:
    """Profiles from (doc_id, text, lang), from about ``sample`` texts of each language, taken by the
    hash of their id. Rows with a null in any of the three are not learned from."""
    known = labelled.select("doc_id", "text", "lang").dropna()
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    dealt = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) * F.col("docs")
    chosen = known.join(F.broadcast(counts), "lang").filter(dealt < sample * 1_000_000)
    total = (
        chosen.select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(_count_batches, "lang string, code bigint, n bigint")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LENGTH)
    lists: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():  # LENGTH rows for each language
        lists.setdefault(row["lang"], []).append(row["code"])
    return Profiles(lists)


def predicted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``, from the text alone.

    A null text or one without a letter is ``und`` with score 0, and so is every text where nothing was
    learned. Of equally near languages the first by name is taken. A null doc_id is not held out; extra
    columns are ignored; an empty table gives an empty result.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start in range(0, batch.num_rows, 512):
                piece = batch.slice(start, 512)
                found = [profiles.nearest(text) for text in piece.column(2).to_pylist()]
                columns = [
                    *piece.columns[:2],
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(
        F.col("doc_id").cast("bigint"), held_out().alias("held_out"), F.col("text").cast("string")
    ).mapInArrow(batches, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Language of every text, learned from the labels of those that are not held out."""
    return predicted(docs, learned(docs.filter(~held_out())))


def in_language(docs: DataFrame, profiles: Profiles, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of ``docs``, all columns kept, whose text is in a learned language: not ``und`` and with a
    score of ``min_score`` or more. Where nothing was learned all rows with a text stay."""

    at, least = docs.columns.index("text"), max(min_score, 1e-9)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = batch.column(at).cast(pa.string())
            kept = [profiles.nearest(text.as_py())[1] >= least for text in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))

    if not profiles.languages:
        return docs.filter(F.col("text").isNotNull())
    return docs.mapInArrow(batches, docs.schema)
