"""Ordinal quality classifier: cumulative-link regression on graded ratings over hashed text.

A text is a sparse vector of hashed words, of their first four bytes, of hashed word shapes (runs of
small letters, capitals, digits and each other sign), and its shares of repeated words and of repeated five-word windows; entries are square
roots of shares, so texts of any length compare. With shared weights w and ordered thresholds t,
P(grade <= k) = sigmoid(t_k - w x). The expected grade ranks documents and the tail probability
P(grade >= k) selects them.

Grades are 0 toxic, 1 low quality, 2 good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import chunks, mix, owners, shingles, slices, words

BITS = 18
# Bytes at the start of a word that count as its stem.
STEM = 4
GRADES = 3
# Labelled documents that the model is fitted on, about; all where there are fewer.
SAMPLE = 10000
EPOCHS = 15
BATCH = 256
# Steps that small samples are given at least.
STEPS = 600
RATE = 4.0
THRESHOLD_RATE = 0.2
PENALTY = 1e-6
SELECT_GRADE = 2
MIN_TAIL = 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")
# Signs separate words as blanks do, so a word counts the same whatever stands beside it.
_PLAIN = np.full(256, ord(" "), np.uint8)
_PLAIN[_SHAPE == ord("a")] = _PLAIN[_SHAPE == ord("A")] = _PLAIN[_SHAPE == ord("0")] = 1
_PLAIN = np.where(_PLAIN == 1, np.arange(256), _PLAIN).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD, _FORM, _STEM = (np.uint64(x) for x in (0x51ED270B27A5C3F1, 0x2545F4914F6CDD1D, 0x632BE59BD9B4E019))
_REPEATED_WORD, _REPEATED_WINDOW = 0, 1


def _shares(owner: np.ndarray, bucket: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, bucket, root of the share) of each bucket that occurs in a text."""
    key, counts = np.unique((owner << BITS) | bucket, return_counts=True)
    text = key >> BITS
    return text, key & ((1 << BITS) - 1), np.sqrt(counts / sizes[text])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each text's entries, bucket, value) of the texts of a chunk."""
    found = words(_PLAIN[data], offsets)
    rows = len(offsets) - 1
    sizes = np.diff(found.offsets)
    owner = owners(found.offsets)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[:-1][offsets[:-1] < len(shape)]] = True
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    forms = words(shape[keep], kept_before[offsets], lower=False)
    shift = np.uint64(64 - BITS)
    parts = [
        _shares(owner, ((found.hashes * _WORD) >> shift).astype(np.int64), sizes),
        _shares(
            owners(forms.offsets),
            ((forms.hashes * _FORM) >> shift).astype(np.int64),
            np.diff(forms.offsets),
        ),
    ]
    head = np.zeros(len(owner), np.uint64)
    for j in range(STEM):
        at = found.starts + j
        byte = np.where(at < found.ends, _LOWER[data[np.minimum(at, len(data) - 1)]], 0)
        head = (head << np.uint64(8)) | byte.astype(np.uint64)
    parts.append(_shares(owner, (mix(head * _STEM) >> shift).astype(np.int64), sizes))
    same = np.zeros(len(owner), bool)
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
    windows, bounds = shingles(found)
    at = owners(bounds)
    order = np.lexsort((windows, at))
    again = np.zeros(len(at), bool)
    again[1:] = (windows[order][1:] == windows[order][:-1]) & (at[order][1:] == at[order][:-1])
    for bucket, owned in ((_REPEATED_WORD, owner[same]), (_REPEATED_WINDOW, at[order][again])):
        parts.append(_shares(owned, np.full(len(owned), bucket), sizes))
    text, bucket, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(text, kind="stable")
    return np.searchsorted(text[order], np.arange(rows + 1)), bucket[order], value[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _ordered(thresholds: np.ndarray) -> np.ndarray:
    """Each threshold above the one before it."""
    gaps = 1e-3 * np.arange(len(thresholds))
    return np.maximum.accumulate(thresholds - gaps) + gaps


@dataclass
class Model:
    """Shared weights and ordered thresholds; without thresholds nothing was learned."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, bounds: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k of 1 and up, one row for each text."""
        total = np.concatenate(([0.0], np.cumsum(self.weights[bucket] * value)))
        score = total[bounds[1:]] - total[bounds[:-1]]
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(bounds: np.ndarray, bucket: np.ndarray, value: np.ndarray, grades: np.ndarray) -> Model:
    """Maximum likelihood by mini-batches with steps that shrink by the gradients seen so far."""
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    share = np.array([(grades <= k).mean() for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    thresholds = _ordered(np.log(share / (1 - share)))
    seen_thresholds = np.full(GRADES - 1, 1e-3)
    draw = np.random.Generator(np.random.PCG64(9))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(grades)))):
        order = draw.permutation(len(grades))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            counts = bounds[rows + 1] - bounds[rows]
            entry = np.repeat(bounds[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            own, at = np.repeat(np.arange(len(rows)), counts), bucket[entry]
            score = np.bincount(own, weights[at] * value[entry], len(rows))
            grade = grades[rows]
            edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
            upper = np.where(grade < GRADES - 1, _sigmoid(edges[grade + 1] - score), 1.0)
            lower = np.where(grade > 0, _sigmoid(edges[grade] - score), 0.0)
            slope = (1 - upper - lower) / len(rows)
            mass = np.maximum(upper - lower, 1e-9) * len(rows)
            step = np.bincount(grade, -upper * (1 - upper) / mass, GRADES)[: GRADES - 1]
            step += np.bincount(grade, lower * (1 - lower) / mass, GRADES)[1:]
            gradient = np.bincount(at, slope[own] * value[entry], 1 << BITS) + PENALTY * weights
            seen += gradient**2
            weights -= RATE * gradient / np.sqrt(seen)
            seen_thresholds += step**2
            thresholds = _ordered(thresholds - THRESHOLD_RATE * step / np.sqrt(seen_thresholds))
    return Model(weights.astype(np.float32), thresholds)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(0)):
            bounds, bucket, value = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(first, end - first),
                    slices(bucket.astype(np.int32), bounds),
                    slices(value.astype(np.float32), bounds),
                ],
                ["grade", "buckets", "entries"],
            )


def grade() -> Column:
    """Grade of a labelled document from quality (0 or 1) and toxic (0 or 1)."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).cast("int")


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on about ``sample`` labelled documents, taken by the hash of their id.

    Labels with a null and documents without text are left out. With fewer than two grades there is
    nothing to learn.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), "quality", "toxic").dropna()
    share = sample / max(known.count(), 1)
    dealt = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1_000_000))
    chosen = known.filter(dealt < share * 1_000_000).select("doc_id", grade().alias("grade"))
    rows = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .filter("text is not null")
        .join(F.broadcast(chosen), "doc_id")  # about ``sample`` rows
        .orderBy("doc_id")
        .select("text", "grade")
        .mapInArrow(_feature_batches, "grade int, buckets binary, entries binary")
        .toArrow()
    )
    grades = np.array(rows.column("grade").to_pylist(), np.int64)
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(0))
    buckets = [np.frombuffer(x, np.int32) for x in rows.column("buckets").to_pylist()]
    entries = np.frombuffer(b"".join(rows.column("entries").to_pylist()), np.float32)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in buckets])))
    return fit(bounds, np.concatenate(buckets).astype(np.int64), entries.astype(np.float64), grades)


def _tails(texts: pa.Array, model: Model) -> np.ndarray:
    if not len(model.thresholds):
        return np.ones((len(texts), GRADES - 1))
    parts = [model.tails(*features(data, offsets)) for _, _, data, offsets in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, GRADES - 1))


def graded(docs: DataFrame, model: Model, min_tail: float = MIN_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_toxic_free = P(grade >= 1), tail_good = P(grade >= 2), kept: one row
    for each row of ``docs``.

    A document is kept where tail_good is ``min_tail`` or more. A null text counts as empty and is
    graded by the thresholds alone. Where nothing was learned both tails are 1. Rows that repeat a
    doc_id are graded each; extra columns are ignored; an empty table gives an empty result.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            tails = _tails(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(tails.sum(axis=1)),
                    pa.array(tails[:, 0]),
                    pa.array(tails[:, -1]),
                    pa.array(tails[:, SELECT_GRADE - 1] >= min_tail),
                ],
                ["doc_id", "expected_grade", "tail_toxic_free", "tail_good", "kept"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        batches,
        "doc_id bigint, expected_grade double, tail_toxic_free double, tail_good double, kept boolean",
    )


def selected(docs: DataFrame, model: Model, min_tail: float = MIN_TAIL) -> DataFrame:
    """Rows of ``docs``, all columns kept, whose tail probability is ``min_tail`` or more."""

    at = docs.columns.index("text")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            tails = _tails(batch.column(at).cast(pa.string()), model)
            yield batch.filter(pa.array(tails[:, SELECT_GRADE - 1] >= min_tail))

    return docs.mapInArrow(batches, docs.schema)
