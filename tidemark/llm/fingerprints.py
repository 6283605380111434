"""Document fingerprints by MinHash: one 16-bit value for each of 128 universal hash permutations.

A permutation maps a five-word shingle's hash x to ``a x + b`` modulo 2^32 with odd a; the least value
over the text's shingles, folded to 16 bits, is one place of the fingerprint. The share of equal
places estimates the Jaccard similarity of two texts' shingle sets, so equal texts agree in all.
A text without words has a fixed fingerprint of its own.

``with_edits`` compares each document with the one that follows it and with an edit of itself.
``near_pairs`` joins bands of the fingerprints and verifies Jaccard similarities. ``compared`` returns both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import near_dedup
from tidemark.llm.joins import join_stored
from tidemark.llm.words import binary, chunks, shingles, words
from tidemark.plans.durable import discard, written
from tidemark.plans.sizing import left_join

PLACES = 128
BANDS = 32
ROWS = PLACES // BANDS
PERCENT = 75

_DRAW = np.random.Generator(np.random.PCG64(5))
_A = _DRAW.integers(0, 1 << 32, PLACES, dtype=np.uint32) | np.uint32(1)
_B = _DRAW.integers(0, 1 << 32, PLACES, dtype=np.uint32)
_FOLD = np.uint32(0x9E3779B1)


def minhash(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 16-bit values for each text's stretch of shingle hashes."""
    out = np.full((len(offsets) - 1, PLACES), 0xFFFF, np.uint16)
    filled = np.flatnonzero(np.diff(offsets))
    if not len(filled):
        return out
    starts = offsets[:-1][filled]
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    value = np.empty_like(x)
    for j in range(PLACES):
        np.multiply(x, _A[j], out=value)
        np.add(value, _B[j], out=value)
        least = np.minimum.reduceat(value, starts)
        out[filled, j] = (least * _FOLD) >> np.uint32(16)
    return out


def of_texts(texts: pa.Array) -> np.ndarray:
    """Fingerprints of the texts, one row each; null counts as empty."""
    parts = [minhash(*shingles(words(data, offsets))) for _, _, data, offsets in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, PLACES), np.uint16)


def shown(prints: np.ndarray) -> list[str]:
    """Each fingerprint as lowercase hex."""
    big = np.ascontiguousarray(prints.astype(">u2"))
    return [row.tobytes().hex() for row in big]


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (one == other).mean(axis=1)


def _parts(docs: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Cut points of doc_id, and for the first id of each stretch the stretch before it.

    The last stretch comes before the first. There are three stretches for each shuffle partition,
    so what the driver holds is bounded by that setting.
    """
    spark = docs.sparkSession
    count = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("bigint"))
    shares = [i / count for i in range(1, count)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 10 * count).alias("cuts")).first()[0]
    cuts = np.unique(np.array(found or [], np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _part_of(batch.column(0), cuts)
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0)], ["part", "doc_id"])

    firsts = (
        ids.mapInArrow(place, "part int, doc_id bigint")
        .groupBy("part")
        .agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first"))
        .orderBy("part")
        .collect()
    )
    before = {row["first"]: firsts[i - 1]["part"] for i, row in enumerate(firsts)}
    return cuts, before


def _part_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    known = pc.fill_null(ids, -(2**63)).to_numpy(zero_copy_only=False)
    return np.searchsorted(cuts, known, "right").astype(np.int32)


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and the next's.

    The edited text has the last quarter of the code points replaced by the first as many (or all) of
    the next document in order of doc_id; after the last comes the first. One row for each row: a null
    text counts as empty; a null doc_id comes first, rows that repeat a doc_id follow each other in
    order of text, and a single document is its own next. Extra columns are ignored; an empty table
    gives an empty result.

    Texts travel once: stretches of doc_id meet in a task in order, and the first document of each
    stretch is sent to the one before it as well.
    """
    cuts, before = _parts(docs)
    heads = pa.array(list(before), pa.int64())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            part = _part_of(ids, cuts)
            ahead = np.zeros(len(part), bool)
            names = ["part", "ahead", "doc_id", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(ahead), ids, texts], names)
            known = pc.fill_null(ids, -(2**63))
            first = pc.is_in(known, heads)
            if pc.any(first).as_py():
                back = np.array([before[i] for i in known.filter(first).to_pylist()], np.int32)
                ahead = np.ones(len(back), bool)
                columns = [pa.array(back), pa.array(ahead), ids.filter(first), texts.filter(first)]
                yield pa.RecordBatch.from_arrays(columns, names)

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .mapInArrow(place, "part int, ahead boolean, doc_id bigint, text string")
        .repartition(partitions, "part")
        .sortWithinPartitions("part", "ahead", F.asc_nulls_first("doc_id"), "text")
        .mapInArrow(
            _edited_batches,
            "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double",
        )
    )


def _edited(text: str, after: str) -> str:
    quarter = len(text) // 4
    return text[: len(text) - quarter] + after[:quarter]


def _edited_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is paired with the one after it until the row sent ahead."""
    held: tuple | None = None
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            piece = batch.slice(start, 512)
            ahead, ids = piece.column(1).to_pylist(), piece.column(2).to_pylist()
            texts, prints = piece.column(3).to_pylist(), of_texts(piece.column(3))
            if held is not None:
                ahead, ids, texts = [held[0], *ahead], [held[1], *ids], [held[2], *texts]
                prints = np.concatenate((held[3], prints))
            # Rows after the first one sent ahead belong to the next stretch.
            at = np.array([i for i in range(len(ids) - 1) if not ahead[i]], np.int64)
            if len(at):
                edited = [_edited(texts[i], texts[i + 1]) for i in at]
                changed = of_texts(pa.array(edited, pa.string()))
                own = prints[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in at], pa.int64()),
                        pa.array([len(texts[i]) for i in at], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                        pa.array(shown(own)),
                        pa.array(shown(changed)),
                        pa.array(likeness(own, changed)),
                        pa.array(likeness(own, prints[at + 1])),
                    ],
                    [
                        "doc_id",
                        "n_chars",
                        "edited_sha256",
                        "fingerprint",
                        "edited_fingerprint",
                        "near_edited",
                        "near_next",
                    ],
                )
            held = (ahead[-1], ids[-1], texts[-1], prints[-1:])


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(1)):
            found = shingles(words(data, offsets))
            values, bounds = near_dedup.distinct_sets(*found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, end - first),
                    binary(minhash(*found)),
                    pa.array(np.diff(bounds)),
                    pa.array(near_dedup._digests(values, bounds, 11)),
                    pa.array(near_dedup._digests(values, bounds, 23)),
                ],
                ["doc_id", "fingerprint", "n_shingles", "set_a", "set_b"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = []
        for _, _, data, offsets in chunks(batch.column(1)):
            hashes, bounds = shingles(words(data, offsets))
            members += [np.unique(hashes[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(members, pa.binary())], ["id", "members"])


def _jaccard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = []
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            values.append(common / max(len(a) + len(b) - common, 1))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(values, pa.float64())], ["doc_id", "near_doc", "jaccard"]
        )


def _jaccards(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """Those (doc_id, near_doc) of similarity 0.75 or more, with their Jaccard similarity."""
    wanted = pairs.select(F.col("doc_id").alias("id")).unionByName(pairs.select(F.col("near_doc").alias("id")))
    sets = written(
        join_stored(
            source.withColumnRenamed("doc_id", "id"), wanted.distinct(), ["id"], "left_semi", "print-ids"
        ).mapInArrow(_set_batches, "id bigint, members binary"),
        "print-sets",
    )
    checked = (
        pairs.join(sets.toDF("doc_id", "left"), "doc_id")
        .join(sets.toDF("near_doc", "right"), "near_doc")
        .select("doc_id", "near_doc", "left", "right")
        .mapInArrow(_jaccard_batches, "doc_id bigint, near_doc bigint, jaccard double")
        .filter(F.col("jaccard") >= PERCENT / 100)
    )
    near = written(checked, "print-near")
    discard(sets)
    return near


def near_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, near_doc, jaccard): documents and smaller ones of similarity 0.75 or more.

    Bands of four places are joined; in each band a document is compared with the smallest doc_id, and
    where it is not similar to that one with all others of the band, in blocks. So of the
    documents that share a band with it the smallest similar one is among its pairs; pairs of documents that
    are both similar to the smallest of their band may be left out. Equal sets of shingles count as one document
    in the search; a copy has a pair with the smallest document of its set and with the smallest that is similar
    to that one. Rows without words or doc_id have no pairs.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    prints = written(
        source.mapInArrow(_print_batches, "doc_id bigint, fingerprint binary, n_shingles bigint, set_a bigint, set_b bigint")
        .filter("n_shingles > 0 and doc_id is not null"),
        "prints",
    )
    first = written(
        prints.groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("first"),
            F.min("n_shingles").alias("n_shingles"),
            F.min("fingerprint").alias("fingerprint"),
        ),
        "print-firsts",
    )
    copies = (
        prints.select("doc_id", "set_a", "set_b")
        .join(first.select("set_a", "set_b", "first"), ["set_a", "set_b"])
        .filter("doc_id <> first")
        .select("doc_id", F.col("first").alias("near_doc"))
    )
    copies = written(copies.distinct(), "print-copies")
    discard(prints)
    key = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring("fingerprint", i * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    banded = first.select(F.col("first").alias("node"), "n_shingles", F.explode(key).alias("band"))
    lowest = banded.groupBy("band").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n"))
    members = written(
        banded.join(lowest.filter("n > 1").drop("n"), "band").filter("node <> low"), "print-members"
    )
    discard(first)
    star = members.select(F.col("node").alias("doc_id"), F.col("low").alias("near_doc"))
    near = _jaccards(written(copies.unionByName(star).distinct(), "print-pairs"), source)
    # Documents that are similar to the smallest of a band get its label; the others one of their own.
    linked = near.select(F.col("doc_id").alias("node"), F.col("near_doc").alias("low"), F.lit(True).alias("linked"))
    labelled = members.join(linked.distinct(), ["node", "low"], "left")
    labelled = labelled.withColumn("label", F.when(F.col("linked"), F.col("low")).otherwise(F.col("node")))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    left = labelled.join(mixed.filter("l0 <> l1").select("band"), "band")
    left = written(left.select("band", "node", "n_shingles", "label"), "print-left")
    discard(members)
    more = near_dedup._block_links(left, docs).select(F.col("b").alias("doc_id"), F.col("a").alias("near_doc"))
    more = written(
        more.distinct().join(near.select("doc_id", "near_doc"), ["doc_id", "near_doc"], "left_anti"), "print-more"
    )
    near = near.unionByName(_jaccards(more, source))
    discard(left, more)
    smallest = near.join(copies, ["doc_id", "near_doc"], "left_anti").groupBy("doc_id")
    smallest = smallest.agg(F.min(F.struct("near_doc", "jaccard")).alias("near"))
    of_copies = copies.join(smallest.withColumnRenamed("doc_id", "first"), F.col("near_doc") == F.col("first"))
    return near.unionByName(of_copies.select("doc_id", "near.near_doc", "near.jaccard"))


def compared(docs: DataFrame) -> DataFrame:
    """``with_edits`` with the smallest document of similarity 0.75 or more that ``near_pairs`` finds, and
    the Jaccard similarity to it; null where there is none."""
    # Rows that repeat a doc_id have a similarity for each of their texts; the largest counts.
    near = near_pairs(docs).groupBy("doc_id", "near_doc").agg(F.max("jaccard").alias("jaccard"))
    near = near.groupBy("doc_id").agg(F.min(F.struct("near_doc", "jaccard")).alias("near"))
    near = written(near.select("doc_id", "near.near_doc", "near.jaccard"), "print-nearest")
    return left_join(with_edits(docs), near, ["doc_id"], ["doc_id"], store_table=False)
