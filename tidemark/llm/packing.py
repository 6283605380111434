"""Batches under a token budget, in length buckets that pad least.

Dynamic programming over the histogram of all lengths finds the bucket boundaries for which padding
every document to its bucket's boundary costs the fewest tokens. Lengths are counted on a grid, exact
up to 256 and in steps of 1/128 above, so the histogram has a few thousand places at most whatever
the corpus, each counted as long as its longest document; documents are padded to the longest of their bucket. In a bucket, documents in order of length
fill one batch after the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.durable import written
from tidemark.plans.ordered import OrderedRows, Running

BUCKETS = 16
BUDGET = 1 << 16
EXACT = 256
SEPARATORS = r"[ \t-\r]+"


def word_count(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]`` in a text; null counts as empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1)
    return F.size(pieces) - F.size(F.filter(pieces, lambda x: x == "")).cast("bigint")


def grid_length(length: Column) -> Column:
    """The least place of the grid at or above a length; a document without tokens takes one."""
    step = F.pow(2.0, F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 7)
    step = F.greatest(step, F.lit(1.0)).cast("bigint")
    return F.when(length <= EXACT, F.greatest(length, F.lit(1))).otherwise(
        F.floor((length + step - 1) / step) * step
    ).cast("bigint")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` stretches of the sorted lengths with the least padded total."""
    if not lengths:
        return []
    ends = np.array(lengths, np.float64)
    below = np.concatenate(([0.0], np.cumsum(np.array(counts, np.float64))))
    best = np.concatenate(([0.0], np.full(len(ends), np.inf)))  # of the first i lengths
    froms = []
    for _ in range(min(buckets, len(ends))):
        cost, chosen = np.full(len(best), np.inf), np.zeros(len(best), np.int64)
        cost[0] = 0
        for j in range(1, len(best)):
            total = best[:j] + (below[j] - below[:j]) * ends[j - 1]
            chosen[j] = np.argmin(total)
            cost[j] = total[chosen[j]]
        froms.append(chosen)
        best = cost
    out, j = [], len(ends)
    for chosen in reversed(froms):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = int(chosen[j])
    return out[::-1]


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_tokens, batch, slot: one row for each row of ``docs``.

    Tokens are words. padded_tokens is the length to which the bucket's documents are padded; a batch
    holds as many as the budget allows at that length, or one document that is longer than the budget.
    Batches of a bucket and slots of a batch count from 0. A null or empty text has no tokens and is
    padded to one or more; rows that repeat a doc_id are rows of their own; extra columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    count = word_count(F.col("text").cast("string")).cast("bigint")
    rows = written(
        docs.select(F.col("doc_id").cast("bigint"), count.alias("n_tokens")), "pack-lengths"
    )
    placed = rows.withColumn("grid", grid_length(F.col("n_tokens")))
    histogram = placed.groupBy("grid").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("longest")
    )
    histogram = histogram.orderBy("grid").collect()
    # One row for each place of the grid that occurs; what counts there is its longest document.
    longest = [max(x["longest"], 1) for x in histogram]
    ends = boundaries(longest, [x["n"] for x in histogram], buckets)
    number = np.searchsorted(np.array(ends, np.int64), longest).tolist()
    table = [(x["grid"], k, ends[k]) for x, k in zip(histogram, number, strict=True)]
    lookup = spark.createDataFrame(table, "grid bigint, bucket int, padded_tokens bigint")
    bucketed = placed.join(F.broadcast(lookup), "grid").drop("grid")
    ranked = OrderedRows.of(bucketed, ["n_tokens", "doc_id"], ["bucket"]).running(
        place=Running("count", F.lit(1), before=True)
    )
    room = F.greatest(F.floor(F.lit(budget) / F.col("padded_tokens")), F.lit(1)).cast("bigint")
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "padded_tokens",
        F.floor(F.col("place") / room).cast("bigint").alias("batch"),
        F.pmod("place", room).cast("bigint").alias("slot"),
    )
