"""Near-duplicate documents by HyperMinHash sketches, banded, estimated, and verified on full sets.

Two documents are linked where their sets of five-word shingles have a Jaccard similarity of 0.75 or
more; the components of the links are the groups.

A document's shingle hashes are dealt into 128 buckets by their leading bits. Each bucket keeps the
least hash in 16 bits: the number of its leading zeros and the ten bits after the first one. An empty
bucket borrows from another that a fixed random sequence names. 32 bands of four registers are the
search keys: a pair at exactly 0.75 is missed by all with a chance of about 5e-6.

Documents with equal sets become one node before the search. In each band all nodes are compared
with the smallest. Where the links found so far leave the rest of a band in several components, each
is compared with those of the other components, in blocks of which only pairs that may link come out. So
a band of linked copies costs a comparison each, and no pair of different components that shares a
band is left undecided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.joins import join_stored
from tidemark.llm.words import (
    binary,
    chunks,
    mix,
    owners,
    shingles,
    slices,
    words,
)
from tidemark.plans.durable import written

BUCKETS = 128
BANDS = 32
ROWS = BUCKETS // BANDS
HASH_BITS = 48
VALUE_BITS = HASH_BITS - 7
MANTISSA = 10
PERCENT = 75
BLOCK = 1 << 16
# Two unequal minima share a register with about this chance: 2^-MANTISSA times the chance of equal
# numbers of leading zeros, a third.
COLLISION = 2.0**-MANTISSA / 3

_U = np.uint64
_DONORS = np.random.Generator(np.random.PCG64(7)).integers(0, BUCKETS, (256, BUCKETS))


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes (48 bits) of each text, and their offsets."""
    keyed = (owners(offsets).astype(np.uint64) << _U(HASH_BITS)) | (hashes >> _U(64 - HASH_BITS))
    keyed.sort()
    if len(keyed):
        keyed = keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))]
    bounds = np.arange(len(offsets), dtype=np.uint64) << _U(HASH_BITS)
    return keyed & _U((1 << HASH_BITS) - 1), np.searchsorted(keyed, bounds)


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Compressed registers of each set (one row of 16-bit values); 0 where the set is empty."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.uint16)
    if not len(values):
        return out
    owner = owners(offsets)
    bucket = (values >> _U(VALUE_BITS)).astype(np.int64)
    cell = owner * BUCKETS + bucket
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    least = values[first] & _U((1 << VALUE_BITS) - 1)
    bits = np.frexp(least.astype(np.float64))[1]
    shifted = (least << (VALUE_BITS - bits).astype(np.uint64)) & _U((1 << (VALUE_BITS - 1)) - 1)
    mantissa = (shifted >> _U(VALUE_BITS - 1 - MANTISSA)).astype(np.uint16)
    zeros = (VALUE_BITS - bits + 1).astype(np.uint16)
    out.reshape(-1)[cell[first]] = (zeros << MANTISSA) | mantissa
    return out


def densified(sketch: np.ndarray) -> np.ndarray:
    """Empty registers filled from others of the same set, equally for equal registers."""
    out = sketch.copy()
    filled = sketch != 0
    rows = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    at_row, at_bucket = np.nonzero(~filled[rows])
    at_row = rows[at_row]
    for donors in _DONORS:
        if not len(at_row):
            return out
        donor = donors[at_bucket]
        found = filled[at_row, donor]
        out[at_row[found], at_bucket[found]] = sketch[at_row[found], donor[found]]
        at_row, at_bucket = at_row[~found], at_bucket[~found]
    for step in range(1, BUCKETS):  # the few that no fixed sequence served: the next one on the right
        donor = (at_bucket + step) % BUCKETS
        found = filled[at_row, donor] & (out[at_row, at_bucket] == 0)
        out[at_row[found], at_bucket[found]] = sketch[at_row[found], donor[found]]
    return out


def _digests(values: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values + _U(seed)))))
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, end, data, offsets in chunks(texts):
            values, bounds = distinct_sets(*shingles(words(data, offsets)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, end - first),
                    pa.array(np.diff(bounds)),
                    pa.array(_digests(values, bounds, 11)),
                    pa.array(_digests(values, bounds, 23)),
                    binary(densified(registers(values, bounds))),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "registers"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two digests of the shingle set, and its registers, one row per row."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _sketch_batches,
        "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, registers binary",
    )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, end, data, offsets in chunks(texts):
            values, bounds = distinct_sets(*shingles(words(data, offsets)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, end - first), slices(values, bounds)], ["id", "members"]
            )


def _short_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as distinct 32-bit prefixes of their hashes, half as large."""
    for batch in _set_batches(batches):
        short = [
            np.unique((np.frombuffer(x, np.uint64) >> _U(HASH_BITS - 32)).astype(np.uint32)).tobytes()
            for x in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], ["id", "members"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint16).reshape(-1, width)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets behind two register matrices, freed of chance collisions."""
    share = (a == b).mean(axis=1)
    return np.clip((share - COLLISION) / (1 - COLLISION), 0, 1)


def _estimate_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose estimate is within six standard errors of the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (_matrix(batch.column(i), BUCKETS) for i in (2, 3))
        sizes = np.minimum(batch.column(4).to_numpy(), BUCKETS)
        limit = PERCENT / 100
        error = np.sqrt(limit * (1 - limit) / np.maximum(sizes, 1))
        near = pa.array(estimated(left, right) >= limit - 6 * error)
        yield batch.select([0, 1]).filter(near)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = np.zeros(batch.num_rows, bool)
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        for i, (left, right) in enumerate(pairs):
            a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            both = np.sort(np.concatenate((a, b)), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            kept[i] = 100 * common >= PERCENT * (len(both) - common)
        yield batch.select([0, 1]).filter(pa.array(kept))


def _common(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of each of the first ``split`` sets with each of the others."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate(([0], values[1:] != values[:-1])))
    shared = np.bincount(column)[column] > 1
    owner = owner[shared]
    column = np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((split, len(sets) - split), np.float32)
    for start in range(0, int(column.max(initial=-1)) + 1, 8192):
        here = slice(*np.searchsorted(column, (start, start + 8192)))
        present = np.zeros((len(sets), 8192), np.float32)
        present[owner[here], column[here] - start] = 1
        total += present[:split] @ present[split:].T
    return total


def _near_in(left: list[dict], right: list[dict]) -> Iterator[tuple[int, int]]:
    """Pairs of different components of which the shortened sets do not rule out a link.

    Two hashes may share their first 32 bits, so a shortened set can be smaller than the full one. By
    that difference the common part may be larger than it looks.
    """
    if not left or not right:
        return
    sets = [np.frombuffer(x["members"], np.uint32) for x in (*left, *right)]
    sizes = np.array([x["n_shingles"] for x in (*left, *right)])
    lost = np.maximum(sizes - np.array([len(s) for s in sets]), 0)
    split = len(left)
    common = _common(sets, split) + np.minimum(lost[:split, None], lost[None, split:])
    union = sizes[:split, None] + sizes[None, split:] - common
    labels = np.array([x["label"] for x in (*left, *right)])
    apart = labels[:split, None] != labels[None, split:]
    for i, j in zip(*np.nonzero(apart & (100 * common >= PERCENT * union)), strict=True):
        pair = left[i]["node"], right[j]["node"]
        yield min(pair), max(pair)


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _one_block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for items in batch.column(0):
            items = items.as_py()
            found.update(_near_in(items, items))
        yield _pairs(found)


def _two_block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: set[tuple[int, int]] = set()
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            found.update(_near_in(left.as_py(), right.as_py()))
        yield _pairs(found)


def _block_links(left: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of the components that still meet in a band that may link, each with each, by blocks.

    A band's nodes are dealt into blocks of about ``BLOCK`` shingles; rows are compared within a block
    and, where a band has several, between each two of them. Only pairs that may link come out.
    """
    sets = written(
        _texts(docs, left.select(F.col("node").alias("id")))
        .mapInArrow(_short_batches, "id bigint, members binary")
        .filter(F.octet_length("members") > 0)
        .distinct(),
        "near-short",
    )
    blocks = left.groupBy("band").agg(
        F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")
    placed = left.join(blocks, "band").select("band", "node", "n_shingles", "label", "blocks", block)
    filled = (
        placed.join(sets.withColumnRenamed("id", "node"), "node")
        .groupBy("band", "block", "blocks")
        .agg(F.collect_list(F.struct("node", "n_shingles", "label", "members")).alias("items"))
    )
    inside = filled.select("items").mapInArrow(_one_block_batches, "a bigint, b bigint")
    several = written(filled.filter("blocks > 1").drop("blocks"), "near-blocks")
    between = (
        several.join(several.toDF("band", "block2", "items2"), "band")
        .filter("block < block2")
        .select("items", "items2")
        .mapInArrow(_two_block_batches, "a bigint, b bigint")
    )
    return inside.unionByName(between)


def _undecided(members: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (band, node, n_shingles, label) of bands in which several components meet, leaving out
    the smallest node of each band."""
    labelled = members.join(found.select(F.col("id").alias("node"), "component"), "node", "left")
    labelled = labelled.select("band", "node", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    mixed = mixed.filter("l0 <> l1").select("band")
    sizes = nodes.select("node", "n_shingles")
    return written(labelled.join(mixed, "band").join(sizes, "node"), "near-undecided")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of these ids; a repeated id brings each of its texts."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string"))
    return join_stored(texts, ids.distinct(), ["id"], "left_semi", "near-ids")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the (a, b) pairs that are linked: first by size and estimate, then on their full sets."""
    side = nodes.select("node", "registers", "n_shingles")
    likely = (
        pairs.distinct()
        .join(side.toDF("a", "left", "n_left"), "a")
        .join(side.toDF("b", "right", "n_right"), "b")
        .filter(F.least("n_left", "n_right") * 100 >= F.greatest("n_left", "n_right") * PERCENT)
        .select("a", "b", "left", "right", F.least("n_left", "n_right").alias("n"))
        .mapInArrow(_estimate_batches, "a bigint, b bigint")
    )
    likely = written(likely, "near-likely")
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
    sets = written(
        _texts(docs, wanted)
        .mapInArrow(_set_batches, "id bigint, members binary")
        .filter(F.octet_length("members") > 0)
        .distinct(),
        "near-sets",
    )
    checked = (
        likely.join(sets.toDF("a", "left"), "a")
        .join(sets.toDF("b", "right"), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(_verify_batches, "a bigint, b bigint")
    )
    return written(checked.distinct(), "near-links")


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (id, component) of the ids that are linked with another."""
    rows = written(sketches(docs), "near-sketches")
    classed = rows.filter("doc_id is not null and n_shingles > 0")
    nodes = written(
        classed.groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("node"),
            F.min("n_shingles").alias("n_shingles"),
            F.min("registers").alias("registers"),
        ),
        "near-nodes",
    )
    equal = (
        classed.select("doc_id", "set_a", "set_b")
        .join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"])
        .filter("doc_id <> node")
        .select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    )
    links = written(equal.distinct(), "near-equal")
    key = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    banded = nodes.select("node", F.explode(key).alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n"))
    # Only keys that two nodes share are of use.
    members = written(
        banded.join(shared.filter("n > 1"), "band").filter("node <> low").select("band", "node", "low"),
        "near-members",
    )
    star = members.select(F.col("low").alias("a"), F.col("node").alias("b"))
    links = links.unionByName(_verified(star, nodes, docs))
    found = components(links)
    # The smallest of a band has been compared with all the others.
    more = _verified(_block_links(_undecided(members, found, nodes), docs), nodes, docs)
    return rows, _merged(found, more)


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components after further links (a, b)."""
    label = found.toDF("id", "component")
    ends = more.join(label.toDF("a", "label_a"), "a", "left").join(label.toDF("b", "label_b"), "b", "left")
    ends = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = components(ends)
    moved = joined.toDF("component", "to")
    kept = label.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    # Ids that had no link before are components of their own by now.
    return kept.unionByName(joined.join(label.select("id"), "id", "left_anti"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Nulls and empty texts have no shingles and stand alone. A row without doc_id stands alone, has a
    null component and is kept. Rows that repeat a doc_id are one node and share a component. Extra
    columns are ignored; an empty table gives an empty result.
    """
    rows, found = groups(docs)
    return rows.join(found, rows["doc_id"] == found["id"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns kept, without those whose group has a smaller doc_id.

    Rows that repeat a kept doc_id all stay, and so do rows without doc_id.
    """
    _, found = groups(docs)
    name = "id"
    while name in docs.columns:
        name = f"_{name}"
    gone = found.filter("component <> id").select(F.col("id").alias(name))
    keyed = docs.withColumn(name, F.col("doc_id").cast("bigint"))
    return join_stored(keyed, gone, [name], "left_anti", "near-gone").select(*docs.columns)


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (
  SELECT one.doc_id AS a, two.doc_id AS b, count(*) AS c
  FROM s one JOIN s two ON one.x = two.x AND one.doc_id <> two.doc_id GROUP BY a, b),
link AS (
  SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
reach(id, top) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT link.b, reach.top FROM reach JOIN link ON link.a = reach.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, low AS component_id, low = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(top) AS low FROM reach GROUP BY id) r ON r.id = d.doc_id
"""
