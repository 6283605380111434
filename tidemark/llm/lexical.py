"""Ranked lexical search: LEMP-style norm buckets over impact vectors.

A document is a vector of impacts, one for each of its terms that some item asks for; an item is a vector of
term weights. The score is their inner product in whole numbers. Each task orders its vectors by
length and goes through them in buckets, the longest first. By Cauchy-Schwarz no document of a bucket scores above
the item's length times the longest of the bucket; an item whose tenth best score so far is beyond that is done with
all buckets that follow. Inside a bucket the item's heaviest coordinates are added up first. What the others
can still add is bounded twice: by their share of the item's length times what is left of the document's, and by the
largest impact of each in the bucket. Documents that may still enter the best are scored in full, in 64-bit
integers. Bounds are rounded up and only scores strictly below the tenth are given up, so ties are kept.

Items are taken in blocks of a bounded number of terms, every block against all documents: the one thing that
travels to the tasks are a block's terms and weights. Documents stay where they lie; a task hands on its best for each
item, and the best of these are the result. Terms are told apart by 64 bits of their hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import chunks, owners, slices, words
from tidemark.plans.durable import written

BEST = 10
# Terms of a block of items, about; one item is never split.
BLOCK_TERMS = 1_000_000
BUCKET_ROWS = 1024
# Heaviest coordinates that are added up before the bounds are tried.
FOCUS = 6
# Bounds are raised by this share for rounding.
SLACK = 1e-9

_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = False
for _first, _last in ((b"0", b"9"), (b"A", b"Z"), (b"a", b"z")):
    _BETWEEN[_first[0] : _last[0] + 1] = False

VECTORS = "doc_id long, n_terms long, terms binary, counts binary"
IMPACTS = "doc_id long, length double, terms binary, impacts binary"
FOUND = "item int, doc_id long, score long"


def _item_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, text) to (item_id, term)."""
    for batch in source:
        for first, end, data, offsets in chunks(batch.column(1)):
            found = words(data, offsets, between=_BETWEEN)
            ids = batch.column(0).slice(first, end - first).take(pa.array(owners(found.offsets)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.hashes.view(np.int64))], ["item_id", "term"])


def _vector_batches(vocabulary: np.ndarray):
    """Rows (doc_id, text) of texts with a term to ``VECTORS``: places in the vocabulary, and their counts."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for first, end, data, offsets in chunks(batch.column(1)):
                found = words(data, offsets, between=_BETWEEN)
                own = found.hashes.view(np.int64)
                place = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[place] == own)
                key, counts = np.unique(
                    owners(found.offsets)[known] << 32 | place[known], return_counts=True
                )
                sizes = np.diff(found.offsets)
                rows = np.flatnonzero(sizes)
                bounds = np.searchsorted(key >> 32, np.append(rows, end - first))
                ids = batch.column(0).slice(first, end - first).take(pa.array(rows))
                columns = [
                    ids,
                    pa.array(sizes[rows]),
                    slices((key & 0xFFFFFFFF).astype(np.int32), bounds),
                    slices(counts.astype(np.int32), bounds),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_terms", "terms", "counts"])

    return batches


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binary lists, and the bounds of each row's."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def _holder_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a batch hold each term."""
    for batch in source:
        if batch.num_rows:
            place, counts = np.unique(_flat(batch.column(0), np.int32)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(counts)], ["place", "n"])


def scaled_sizes(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 90 + (90 * n * documents) div terms."""
    if len(n) and int(n.max()) * 90 * documents >= 1 << 63:
        return np.array([10 + 90 * x * documents // terms for x in n.tolist()], np.int64)
    return 10 + 90 * n * documents // terms


def _impact_batches(documents: int, terms: int):
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            place, bounds = _flat(batch.column(2), np.int32)
            tf = _flat(batch.column(3), np.int32)[0].astype(np.int64)
            owner = owners(bounds)
            m = scaled_sizes(batch.column(1).to_numpy(), documents, terms)[owner]
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
            length = np.sqrt(np.bincount(owner, impact.astype(np.float64) ** 2, batch.num_rows))
            columns = [batch.column(0), pa.array(length), slices(place, bounds), slices(impact.astype(np.int32), bounds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "length", "terms", "impacts"])

    return batches


@dataclass
class Items:
    """Items as sparse vectors over a vocabulary, the heaviest coordinates of each first."""

    places: list[np.ndarray]
    weights: list[np.ndarray]

    @classmethod
    def of(cls, places: Sequence[np.ndarray], weight: np.ndarray) -> Items:
        kept = [x[weight[x] > 0] for x in places]
        ordered = [x[np.lexsort((x, -weight[x]))] for x in kept]
        return cls(ordered, [weight[x] for x in ordered])


@dataclass
class Bucket:
    """Documents of similar length: their impacts in order of the terms."""

    docs: np.ndarray
    lengths: np.ndarray
    rows: np.ndarray
    impacts: np.ndarray
    bounds: np.ndarray  # of each term's stretch
    largest: np.ndarray  # of each term's impacts

    @classmethod
    def of(cls, docs, lengths, owner, place, impacts, vocabulary: int) -> Bucket:
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(vocabulary + 1))
        sorted_impacts = impacts[order].astype(np.int64)
        largest = np.zeros(vocabulary, np.int64)
        held = np.flatnonzero(np.diff(bounds))
        if len(held):
            largest[held] = np.maximum.reduceat(sorted_impacts, bounds[held])
        return cls(docs, lengths, owner[order], sorted_impacts, bounds, largest)

    def entries(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, impact and weight of all entries of some terms."""
        first, sizes = self.bounds[places], self.bounds[places + 1] - self.bounds[places]
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.rows[at], self.impacts[at], np.repeat(weights, sizes)


class Search:
    """The best documents of each item among the buckets so far, which come in order of falling length."""

    def __init__(self, items: Items, best: int):
        self.items, self.best = items, best
        self.lengths = [math.sqrt(float((w.astype(np.float64) ** 2).sum())) for w in items.weights]
        self.docs = [np.zeros(0, np.int64) for _ in items.places]
        self.scores = [np.zeros(0, np.int64) for _ in items.places]
        self.open = [i for i, x in enumerate(items.places) if len(x)]
        self.tried = self.rescored = 0

    def threshold(self, item: int) -> int:
        """The score that a document must reach: that of the last of the best, or any above 0."""
        return max(int(self.scores[item][-1]), 1) if len(self.scores[item]) == self.best else 1

    def add(self, bucket: Bucket) -> None:
        longest = float(bucket.lengths.max()) * (1 + SLACK)
        self.open = [i for i in self.open if self.lengths[i] * longest >= self.threshold(i)]
        for item in self.open:
            self._one(item, bucket)

    def _one(self, item: int, bucket: Bucket) -> None:
        places, weights, least = self.items.places[item], self.items.weights[item], self.threshold(item)
        count = len(bucket.docs)
        rows, impacts, own = bucket.entries(places[:FOCUS], weights[:FOCUS])
        score = np.zeros(count, np.int64)
        np.add.at(score, rows, impacts * own)
        survivors = np.ones(count, bool)
        if least > 1:
            seen = np.bincount(rows, impacts.astype(np.float64) ** 2, count)
            rest = math.sqrt(float((weights[FOCUS:].astype(np.float64) ** 2).sum()))
            left = np.sqrt(np.maximum(bucket.lengths**2 * (1 + SLACK) - seen, 0))
            most = float((weights[FOCUS:] * bucket.largest[places[FOCUS:]]).sum())
            survivors = (score + np.minimum(rest * left, most)) * (1 + SLACK) >= least
        self.tried += count
        self.rescored += int(survivors.sum())
        if not survivors.any():
            return
        rows, impacts, own = bucket.entries(places[FOCUS:], weights[FOCUS:])
        inside = survivors[rows]
        np.add.at(score, rows[inside], impacts[inside] * own[inside])
        found = np.flatnonzero(survivors & (score >= least))
        if len(found):
            docs = np.concatenate((self.docs[item], bucket.docs[found]))
            scores = np.concatenate((self.scores[item], score[found]))
            order = np.lexsort((docs, -scores))[: self.best]
            self.docs[item], self.scores[item] = docs[order], scores[order]


def _search_batches(items: Items, vocabulary: int, best: int, bucket_rows: int):
    """Rows of ``IMPACTS`` in order of falling length to the best of each item."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, best)
        for batch in source:
            for first in range(0, batch.num_rows, bucket_rows):
                if not search.open:
                    break
                part = batch.slice(first, bucket_rows)
                place, bounds = _flat(part.column(2), np.int32)
                impacts = _flat(part.column(3), np.int32)[0]
                docs, lengths = part.column(0).to_numpy(), part.column(1).to_numpy()
                search.add(Bucket.of(docs, lengths, owners(bounds), place, impacts, vocabulary))
        sizes = [len(x) for x in search.docs]
        columns = [
            pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *search.docs])),
            pa.array(np.concatenate([np.zeros(0, np.int64), *search.scores])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return batches


def _block(docs: DataFrame, pairs: list, best: int, bucket_rows: int) -> DataFrame:
    """item_id, doc_id, score: the best documents of each task for the items of ``pairs`` (item_id, term)."""
    spark = docs.sparkSession
    vocabulary, place = np.unique(np.array([x["term"] for x in pairs], np.int64), return_inverse=True)
    ids, owner = np.unique(np.array([x["item_id"] for x in pairs], np.int64), return_inverse=True)
    order = np.argsort(owner, kind="stable")
    places = np.split(place[order], np.searchsorted(owner[order], np.arange(1, len(ids))))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    vectors = written(rows.mapInArrow(_vector_batches(vocabulary), VECTORS), "lexical-vectors")
    documents, terms = vectors.agg(F.count(F.lit(1)), F.sum("n_terms")).first()
    holders = vectors.select("terms").mapInArrow(_holder_batches, "place int, n long")
    weight = np.zeros(len(vocabulary), np.int64)
    # One row for each term of the block at most.
    for row in holders.groupBy("place").agg(F.sum("n").alias("df")).collect():
        weight[row["place"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * row["df"] + 1)))
    found = (
        vectors.filter("doc_id is not null and octet_length(terms) > 0")
        .mapInArrow(_impact_batches(documents, terms or 1), IMPACTS)
        .sortWithinPartitions(F.desc("length"))
        .mapInArrow(_search_batches(Items.of(places, weight), len(vocabulary), best, bucket_rows), FOUND)
    )
    named = spark.createDataFrame(list(enumerate(ids.tolist())), "item int, item_id long")
    return found.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    best: int = BEST,
    block_terms: int = BLOCK_TERMS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item with a score above 0.

    Equal scores rank by doc_id. Null texts have no terms; items without terms or without item_id have no
    rows, and rows that repeat an item_id are one item with the terms of all. Documents without doc_id count
    in the statistics but are not ranked; rows that repeat a doc_id are documents of their own; extra columns are
    ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).dropna()
    pairs = written(texts.mapInArrow(_item_batches, "item_id long, term long").distinct(), "lexical-items")
    blocks = max(1, -(-pairs.count() // block_terms))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for number in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        if own:
            found = found.unionByName(_block(docs, own, best, bucket_rows))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= best)
        .select("item_id", "rank", "doc_id", "score")
    )


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
n AS (SELECT r, doc_id, count(*) AS n FROM d GROUP BY r, doc_id),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
f AS (SELECT r, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM f, a GROUP BY term, docs),
s AS (
  SELECT item_id, n.doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT
    AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN n USING (r), a
  WHERE n.doc_id IS NOT NULL GROUP BY item_id, n.doc_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {BEST}
"""
