"""A mix of sources at target weights: Sainte-Laguë apportionment of equal-token blocks.

Each source's words, its documents in a seeded order, form one line that is cut into blocks of equal length.
Targets follow the weights, but no source gives more than ``REPEATS`` times its words; what it cannot give
is shared out among the others anew. Seats (blocks of the mix) go to the sources one after the other by
the highest quotient target / (2 q + 1), q being the seats a source has already. Sainte-Laguë never takes
a seat back when the mix grows, so the sequence is cut into equal stretches, one for each shard:
the quotas of a shard are whole numbers and every shard has the weights of the whole, as nearly as blocks allow.

Which blocks fill a source's seats is drawn by a seeded permutation of its block numbers. It is a
formula, so each document finds its own share from its place in the line. Places come from a running sum over
ordered ranges, so a source with a third of all rows spans many tasks. The driver holds a few numbers for each
source, as the weights do, and the sequence of about ``SEATS`` seats.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.packing import word_count
from tidemark.plans.durable import written
from tidemark.plans.ordered import OrderedRows, Running
from tidemark.plans.sizing import left_join

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEATS = 1 << 20
# Seats for each source at least, where sources are very many.
SEATS_A_SOURCE = 64
SHARDS = 16
SEED = 12


def targets(sizes: Sequence[int], weights: Sequence[int], repeats: int = REPEATS) -> list[float]:
    """Words wanted of each source: shares by weight, none above ``repeats`` times its size."""
    full, rest, free = set(), sum(sizes), sum(weights)
    while True:
        # Whole numbers throughout, so the outcome does not hang on rounding.
        over = [
            i
            for i, (size, weight) in enumerate(zip(sizes, weights, strict=True))
            if i not in full and weight * rest > repeats * size * free
        ]
        if not over:
            break
        full.update(over)
        rest -= repeats * sum(sizes[i] for i in over)
        free -= sum(weights[i] for i in over)
    return [
        float(repeats * size) if i in full or not free else weight * rest / free
        for i, (size, weight) in enumerate(zip(sizes, weights, strict=True))
    ]


def seats(wanted: Sequence[float], limits: Sequence[int], count: int) -> np.ndarray:
    """The source of each seat by highest quotient, equal ones in order of the sources.

    Source i gets no more than ``limits[i]`` seats; fewer than ``count`` come out where those do not suffice.
    """
    goal, most = np.array(wanted, np.float64), np.array(limits, np.int64)
    most = np.where(goal > 0, most, 0)
    count = min(count, int(most.sum()))
    if not count:
        return np.zeros(0, np.int64)
    least = goal.sum() / (2 * count)
    while True:
        # All seats whose quotient reaches ``least``.
        each = np.minimum(most, np.floor((goal / least + 1) / 2).astype(np.int64))
        if each.sum() >= count or (each == most).all():
            break
        least /= 2
    source = np.repeat(np.arange(len(goal)), each)
    number = np.arange(len(source)) - np.repeat(np.cumsum(each) - each, each)
    quotient = goal[source] / (2 * number + 1)
    return source[np.lexsort((source, -quotient))[:count]]


def step_and_shift(blocks: int, source: int, seed: int) -> tuple[int, int]:
    """``a`` and ``c`` for which (a * block + c) mod ``blocks`` is a permutation, drawn by the seed."""
    drawn = hashlib.sha256(f"{seed}:{source}".encode()).hexdigest()
    step, shift = int(drawn[:8], 16) % blocks, int(drawn[8:16], 16) % blocks
    while math.gcd(step, blocks) != 1:
        step += 1
    return step, shift


@dataclass(frozen=True)
class Mix:
    """``rows``: each document with its place in its source's line and the plan of that source."""

    rows: DataFrame
    block: int

    def spans(self) -> tuple[Column, Column, Column]:
        """Blocks a document lies in, and the end of its words in the line."""
        end = F.col("start") + F.col("size")
        first = F.floor(F.col("start") / self.block).cast("bigint")
        return F.sequence(first, F.floor((end - 1) / self.block).cast("bigint")), first, end

    def drawn(self, number: Column) -> Column:
        """Place of a block in the order in which the source's blocks are taken."""
        return F.pmod(F.col("step") * number + F.col("shift"), F.col("blocks"))


def planned(
    docs: DataFrame,
    weights: Sequence[int] | Mapping[str | None, int] = WEIGHTS,
    shards: int = SHARDS,
    seed: int = SEED,
    seat_count: int = SEATS,
) -> Mix:
    spark = docs.sparkSession
    named = F.col("source").cast("string")
    doc = F.col("doc_id").cast("bigint")
    text = F.col("text").cast("string")
    rows = written(
        docs.select(
            doc.alias("doc_id"),
            word_count(text).cast("bigint").alias("size"),
            # A name that tells a missing source from every other.
            F.when(named.isNull(), "1").otherwise(F.concat(F.lit("0"), named)).alias("source"),
            F.substring(
                F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 16
            ).alias("dealt"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "mix-rows",
    )
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found = sorted((row["source"], row["size"]) for row in found)
    names, sizes = [x for x, _ in found], [x for _, x in found]
    if isinstance(weights, Mapping):
        share = [weights.get(name[1:] if name[0] == "0" else None, 0) for name in names]
    else:
        share = [weights[i % len(weights)] for i in range(len(names))]
    wanted = targets(sizes, share)
    total = sum(sizes)
    block = max(1, -(-total // max(seat_count, SEATS_A_SOURCE * len(names))))
    blocks = [max(1, -(-size // block)) for size in sizes]
    limits = [REPEATS * count if size else 0 for count, size in zip(blocks, sizes, strict=True)]
    order = seats(wanted, limits, (2 * total + block) // (2 * block))
    shard = np.arange(len(order)) * shards // max(len(order), 1)
    quotas = np.bincount(order * shards + shard, minlength=len(names) * shards).reshape(len(names), shards)
    plan = [
        (name, size, goal, count, *step_and_shift(count, i, seed), own)
        for i, (name, size, goal, count, own) in enumerate(
            zip(names, sizes, wanted, blocks, np.cumsum(quotas, axis=1).tolist(), strict=True)
        )
    ]
    table = spark.createDataFrame(
        plan,
        "source string, source_size bigint, target double, blocks bigint, step bigint, shift bigint, "
        "quotas array<bigint>",
    )
    placed = OrderedRows.of(rows, ["dealt", "doc_id", "size", "text_hash"], ["source"]).running(
        start=Running("sum", F.col("size"), before=True)
    )
    placed = placed.withColumn("start", F.coalesce("start", F.lit(0)).cast("bigint"))
    return Mix(left_join(placed, table, ["source"], ["dealt"]), block)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: one row for each row of ``docs``.

    size counts words, source_size those of all the source's documents, target is what the mix wants of the
    source, and taken how many of the document's words it takes, those it repeats counted again. ``weights``
    are repeated over the sources in order of code point, the missing source last, or given by name
    (0 where a name is missing). A null or empty text has no words; rows that repeat a doc_id are rows of
    their own; a row without doc_id is mixed too; extra columns are ignored; an empty table gives an empty result.
    """
    mix = planned(docs, **options)
    numbers, _, end = mix.spans()
    quota = F.element_at("quotas", -1)
    rounds = F.floor(quota / F.col("blocks")).cast("bigint")
    inside = lambda b: F.least((b + 1) * mix.block, end) - F.greatest(b * mix.block, F.col("start"))
    more = F.aggregate(
        numbers,
        F.lit(0).cast("bigint"),
        lambda sum_, b: sum_ + F.when(mix.drawn(b) < F.pmod(quota, F.col("blocks")), inside(b)).otherwise(0),
    )
    taken = F.when(F.col("size") > 0, rounds * F.col("size") + more).otherwise(F.lit(0))
    source = F.when(F.col("source") != "1", F.expr("substring(source, 2)"))
    return mix.rows.select(
        "doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), source.alias("source")
    )


def pieces(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: doc_id, source, start_word, end_word (not included), shard, repeat.

    One row for each stretch of a document that a block brings into a shard; the lengths of a document's rows add up
    to what ``mixed`` says is taken of it. Texts are joined by doc_id where the shards are written.
    """
    mix = planned(docs, **options)
    numbers, _, end = mix.spans()
    quota = F.element_at("quotas", -1)
    block = F.col("block")
    return (
        mix.rows.filter("size > 0")
        .withColumn("end", end)
        .withColumn("block", F.explode(numbers))
        .withColumn("place", mix.drawn(block))
        .filter(F.col("place") < quota)
        .withColumn("last", F.floor((quota - 1 - F.col("place")) / F.col("blocks")).cast("int"))
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .withColumn("seat", F.col("place") + F.col("repeat") * F.col("blocks"))
        .select(
            "doc_id",
            F.when(F.col("source") != "1", F.expr("substring(source, 2)")).alias("source"),
            (F.greatest(block * mix.block, F.col("start")) - F.col("start")).alias("start_word"),
            (F.least((block + 1) * mix.block, F.col("end")) - F.col("start")).alias("end_word"),
            F.size(F.filter("quotas", lambda x: x <= F.col("seat"))).alias("shard"),
            "repeat",
        )
    )


SQL = f"""
WITH d AS (
  SELECT doc_id, source, left(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 16) AS dealt,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT
      AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, {list(WEIGHTS)}[rank % {len(WEIGHTS)} + 1] AS weight, sum(source_size) OVER () AS total FROM s),
o AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY source_size / weight, rank
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_from FROM w),
c AS (SELECT *, weight * (total - {REPEATS} * before) > {REPEATS} * source_size * free_from AS over FROM o),
f AS (
  SELECT *, total - {REPEATS} * coalesce(sum(source_size) FILTER (over) OVER (), 0) AS rest,
    sum(weight) FILTER (NOT over) OVER () AS free,
    greatest(1, (total + {SEATS} - 1) // {SEATS})::BIGINT AS block FROM c),
t AS (
  SELECT source, rank, source_size, block, total,
    CASE WHEN over OR free IS NULL THEN {REPEATS}::DOUBLE * source_size
         ELSE (weight * rest)::DOUBLE / free::DOUBLE END AS target,
    greatest(1, (source_size + block - 1) // block)::BIGINT AS blocks FROM f),
seat AS (
  SELECT rank, unnest(range(least({REPEATS} * blocks, (2 * target / block)::BIGINT + 2))) AS q,
    target, block, total FROM t WHERE target > 0),
quota AS (
  SELECT rank, count(*)::BIGINT AS quota FROM (
    SELECT rank, row_number() OVER (ORDER BY target / (2 * q + 1) DESC, rank) AS n,
      (2 * total + block) // (2 * block) AS seats FROM seat) WHERE n <= seats GROUP BY rank),
p AS (
  SELECT t.*, coalesce(quota, 0) AS quota,
    ('0x' || substr(sha256('{SEED}:' || rank), 1, 8))::BIGINT % blocks AS low,
    ('0x' || substr(sha256('{SEED}:' || rank), 9, 8))::BIGINT % blocks AS shift FROM t LEFT JOIN quota USING (rank)),
g AS (SELECT *, list_filter(range(low, low + 1000), lambda x: gcd(x, blocks) = 1)[1] AS step FROM p),
line AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY dealt, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d)
SELECT doc_id, size, source_size, target, line.source,
  CASE WHEN size = 0 THEN 0 ELSE quota // blocks * size + list_sum(list_transform(
    range(start // block, (start + size - 1) // block + 1),
    lambda b: CASE WHEN (step * b + shift) % blocks < quota % blocks
      THEN least((b + 1) * block, start + size) - greatest(b * block, start) ELSE 0 END)) END::BIGINT AS taken
FROM line JOIN g ON line.source IS NOT DISTINCT FROM g.source
"""
