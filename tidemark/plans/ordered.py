"""Running aggregates over a total order, without putting the order into one task.

A running maximum, sum or count over all rows (or over one group that holds a third of them)
cannot be a plain window function: its partition would land in one task. Here the rows are cut
into contiguous ranges of (group, order) by a range shuffle, so a hot group simply spans many
ranges. Each range is aggregated to a partial; the partials (at most two per range) are scanned
to give what each range inherits from the ones before it; the rows are then scanned range by
range and merged with what they inherit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.durable import written
from tidemark.session import INITIAL_PARTITIONS

RANGE = "_range"


@dataclass(frozen=True)
class Running:
    """A running aggregate: ``kind`` of ``value`` over the rows so far.

    ``before`` leaves the current row out.
    """

    kind: str
    value: Column
    before: bool = False

    def over(self, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, -1 if self.before else 0)
        return self.total().over(frame)

    def total(self) -> Column:
        return {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[self.kind](self.value)

    def inherited(self, partial: Column, window) -> Column:
        merge = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}[self.kind]
        return merge(partial).over(window)

    def merged(self, inherited: Column, local: Column) -> Column:
        if self.kind == "max":
            return F.greatest(inherited, local)
        if self.kind == "min":
            return F.least(inherited, local)
        if self.kind == "count":
            return F.coalesce(inherited, F.lit(0)) + local
        return F.coalesce(inherited + local, inherited, local)


class OrderedRows:
    """Rows in ranges of a total order; ``order`` columns must identify a row within its group."""

    def __init__(self, rows: DataFrame, order: Sequence[str], group: Sequence[str] = ()):
        self.rows = rows
        self.order = list(order)
        self.group = list(group)

    @classmethod
    def of(
        cls,
        frame: DataFrame,
        order: Sequence[str],
        group: Sequence[str] = (),
        ranges: int | None = None,
    ) -> OrderedRows:
        """Cut ``frame`` into ranges and store them, so that range numbers never change again.

        Without a number of ranges Spark joins small ones to the advisory size where the session lets shuffles
        begin with many partitions, so that a range stays as large as it is when the data grow.
        """
        conf = frame.sparkSession.conf
        if ranges is None and conf.get(INITIAL_PARTITIONS, None) is None:
            # Twice the shuffle width evens out ranges that meet in one window task.
            ranges = 2 * int(conf.get("spark.sql.shuffle.partitions"))
        count = () if ranges is None else (ranges,)
        cut = frame.repartitionByRange(*count, *group, *order).withColumn(RANGE, F.spark_partition_id())
        return cls(written(cut, "ranges"), order, group)

    def running(self, **columns: Running) -> DataFrame:
        """Add each running aggregate as a column; the result keeps the range number."""
        totals = [spec.total().alias(f"_carry_{name}") for name, spec in columns.items()]
        if self.group:
            partials = self._edge_rows().groupBy(RANGE, *self.group).agg(*totals)
            before = Window.partitionBy(*self.group).orderBy(RANGE)
        else:
            partials = self.rows.groupBy(RANGE).agg(*totals)
            before = Window.partitionBy(F.lit(0)).orderBy(RANGE)
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        carry = partials.select(
            RANGE,
            *self.group,
            *[
                spec.inherited(F.col(f"_carry_{name}"), before).alias(f"_carry_{name}")
                for name, spec in columns.items()
            ],
        )
        local = Window.partitionBy(RANGE, *self.group).orderBy(*self.order)
        # At most two carry rows per range, whatever the data: the broadcast is bounded.
        return (
            _join_on(self.rows, F.broadcast(carry), [RANGE, *self.group], "left")
            .withColumns({f"_local_{name}": spec.over(local) for name, spec in columns.items()})
            .withColumns(
                {
                    name: spec.merged(F.col(f"_carry_{name}"), F.col(f"_local_{name}"))
                    for name, spec in columns.items()
                }
            )
            .drop(*[f"_carry_{name}" for name in columns], *[f"_local_{name}" for name in columns])
        )

    def _edge_rows(self) -> DataFrame:
        """Rows of the first and last group of each range, the only groups that can span ranges."""
        whole = F.struct(*self.group)
        edges = (
            self.rows.groupBy(RANGE)
            .agg(F.min(whole).alias("_first"), F.max(whole).alias("_last"))
            .select(RANGE, F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_edge"))
            .select(RANGE, "_edge.*")
        )
        return _join_on(self.rows, F.broadcast(edges), [RANGE, *self.group], "left_semi")


def _join_on(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Equi join that also matches nulls; keeps only the left side's copy of the join columns."""
    renamed = right.withColumnsRenamed({name: f"_r_{name}" for name in names})
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_r_{name}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{name}" for name in names])


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_order: Sequence[str],
    right_order: Sequence[str],
    take: Sequence[str],
) -> DataFrame:
    """Each left row with the latest right row of its key at or before it, or nulls.

    ``left_order[0]`` and ``right_order[0]`` are compared with each other; the remaining names
    only break ties and must make a row unique within its key. A right row at the same instant
    counts as before. Both sides travel through one range shuffle on (key, time), so a hot key
    spans many ranges.
    """
    state = F.struct(*right_order, *take)
    both = left.select(
        *on,
        F.col(left_order[0]).alias("_at"),
        F.lit(1).alias("_side"),
        F.concat_ws("|", *left_order[1:]).alias("_tie"),
        F.struct("*").alias("_left"),
    ).unionByName(
        right.select(
            *on,
            F.col(right_order[0]).alias("_at"),
            F.lit(0).alias("_side"),
            F.concat_ws("|", *right_order[1:]).alias("_tie"),
            state.alias("_state"),
        ),
        allowMissingColumns=True,
    )
    scanned = OrderedRows.of(both, ["_at", "_side", "_tie"], on).running(
        _latest=Running("max", F.col("_state"))
    )
    return scanned.filter(F.col("_side") == 1).select(
        "_left.*", *[F.col(f"_latest.{name}").alias(name) for name in take]
    )

