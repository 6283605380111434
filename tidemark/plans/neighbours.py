"""Rank and frame functions over a total order that one task cannot hold.

A window function needs the rows of its partition in one task, all of them where it has no PARTITION BY or a
partition that is very large. Here ranks come from running aggregates over ordered ranges
(``plans.ordered``). Frames that count rows are worked on in blocks of equal numbers of rows, each of
which borrows the rows just outside it that its frames reach. Sums over a span of values are the
difference of two running sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.durable import written
from tidemark.plans.ordered import RANGE, OrderedRows, Running

BLOCK_ROWS = 100_000


def ranked(
    rows: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    peers: Sequence[str] | None = None,
    tiles: int | None = None,
) -> DataFrame:
    """``rows`` with ``row_number``, and ``rank`` and ``dense_rank`` by the ``peers`` columns.

    ``order`` must identify a row within its group; ``peers`` is the part of it, from the front, by which
    rows count as equal. With ``tiles`` a column ``ntile`` is added. Rows come out stored.
    """
    order, group = list(order), list(group)
    peers = order if peers is None else list(peers)
    if peers != order[: len(peers)]:
        raise ValueError("peers must be the first columns of the order")
    same = F.struct(*peers)
    first = OrderedRows.of(rows, order, group).running(
        row_number=Running("count", F.lit(1)), _before=Running("max", same, before=True)
    )
    # In ascending order the greatest before a row is the row before it.
    new = F.col("_before").isNull() | (F.col("_before") != same)
    stored = written(first.withColumn("_new", new).drop("_before"), "ranked")
    found = OrderedRows(stored, order, group).running(
        rank=Running("max", F.when(F.col("_new"), F.col("row_number"))),
        dense_rank=Running("count", F.when(F.col("_new"), F.lit(1))),
    )
    found = found.drop("_new", RANGE)
    return written(found, "ranked") if tiles is None else _tiled(written(found, "ranked"), group, tiles)


def _tiled(rows: DataFrame, group: Sequence[str], tiles: int) -> DataFrame:
    """The first n mod ``tiles`` tiles have a row more than the others."""
    if group:
        sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).withColumnsRenamed(
            {name: f"_g_{name}" for name in group}
        )
        same = F.lit(True)
        for name in group:
            same = same & F.col(name).eqNullSafe(F.col(f"_g_{name}"))
        rows = rows.join(sizes, same).drop(*[f"_g_{name}" for name in group])
    else:
        rows = rows.withColumn("_n", F.lit(rows.count()))
    size, more, at = F.floor(F.col("_n") / tiles), F.pmod("_n", F.lit(tiles)), F.col("row_number") - 1
    large = at < more * (size + 1)
    tile = F.when(large, F.floor(at / (size + 1))).otherwise(
        more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1)))
    )
    return rows.withColumn("ntile", (tile + 1).cast("int")).drop("_n")


def framed(
    rows: DataFrame,
    columns: Mapping[str, tuple[Column, int, int]],
    group: Sequence[str] = (),
    number: str = "row_number",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``rows`` with aggregates over frames of rows around each.

    ``columns`` gives for each name an aggregate and the first and last row of its frame, counted from
    the row itself: (sum("x"), -2, 0) for the last three, (max("x"), 1, 1) for the next one. ``number`` counts
    the rows of a group from 1, as ``ranked`` does.
    """
    group = list(group)
    back = max(0, *(-first for _, first, _ in columns.values()))
    ahead = max(0, *(last for _, _, last in columns.values()))
    block_rows = max(block_rows, back + ahead)
    at = F.col(number) - 1
    own = F.floor(at / block_rows).cast("bigint")
    place = F.pmod(at, F.lit(block_rows))
    # A row is lent to the block after if it is among the last of its own, and likewise to the one before.
    lent = F.array_compact(
        F.array(
            own,
            F.when(place >= block_rows - back, own + 1) if back else F.lit(None).cast("bigint"),
            F.when(place < ahead, own - 1) if ahead else F.lit(None).cast("bigint"),
        )
    )
    spread = rows.withColumn("_own", own).withColumn("_block", F.explode(lent))
    window = Window.partitionBy(*group, "_block").orderBy(number)
    return (
        spread.withColumns(
            {name: value.over(window.rowsBetween(first, last)) for name, (value, first, last) in columns.items()}
        )
        .filter(F.col("_own") == F.col("_block"))
        .drop("_own", "_block")
    )


def span_sums(
    rows: DataFrame,
    at: str,
    span: int,
    sums: Mapping[str, Column],
    group: Sequence[str] = (),
    number: str = "row_number",
) -> DataFrame:
    """``rows`` with sums over the rows whose ``at`` lies within ``span`` below the row's own, peers included.

    RANGE BETWEEN span PRECEDING AND CURRENT ROW, for aggregates that are sums; ``at`` is a long and null
    values of it are each other's peers. Two marks per row, at both ends of its frame, run in one ordered scan with the rows, so a
    frame may hold any number of them. ``number`` identifies a row within its group.
    """
    group, names = list(group), list(sums)
    keyed = rows.select(*group, number, F.col(at).alias("_at"), *[x.alias(name) for name, x in sums.items()])
    none = [F.lit(None).cast(keyed.schema[name].dataType).alias(name) for name in names]
    # In the order: the start mark before the rows at its place, the end mark after those.
    marks = F.explode(
        F.array(
            F.struct((F.col("_at") - span).alias("_place"), F.lit(0).alias("_kind")),
            F.struct(F.col("_at").alias("_place"), F.lit(2).alias("_kind")),
        )
    ).alias("_mark")
    both = keyed.select(*group, number, F.col("_at").alias("_place"), F.lit(1).alias("_kind"), *names).unionByName(
        keyed.select(*group, number, marks).select(*group, number, "_mark.*", *none)
    )
    scanned = OrderedRows.of(both, ["_place", "_kind", number], group).running(
        **{f"_run_{name}": Running("sum", F.col(name)) for name in names}
    )
    ends = scanned.filter("_kind <> 1").groupBy(*group, number).agg(
        *[
            F.max(F.when(F.col("_kind") == kind, F.col(f"_run_{name}"))).alias(f"_{kind}_{name}")
            for name in names
            for kind in (0, 2)
        ]
    )
    # A frame that starts before the first value has nothing to be taken off.
    found = ends.select(
        *[F.col(name).alias(f"_k_{name}") for name in (*group, number)],
        *[(F.col(f"_2_{name}") - F.coalesce(f"_0_{name}", F.lit(0))).alias(name) for name in names],
    )
    same = F.lit(True)
    for name in (*group, number):
        same = same & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    return rows.join(found, same).drop(*[f"_k_{name}" for name in (*group, number)])
