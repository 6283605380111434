"""Window results under the watermark: final results, partial results and late corrections.

Replayed over the arrival order, an event's windows split at the watermark of its arrival. For the
windows still open the event is on time (if accepted) and counts towards the first result, version
0. For the windows already closed it is late, accepted or not, and each such window gets a further
version with the event added. A dropped event does not count towards open windows, and a late
event corrects only windows that have a version 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import payload
from tidemark.functions.times import Windows, micros
from tidemark.operators import watermark
from tidemark.operators.windows import (
    SHARES,
    aggregations,
    field_partials,
    finished,
    packed,
    window_partials,
)
from tidemark.plans.durable import written
from tidemark.plans.ordered import OrderedRows, Running
from tidemark.schemas import ARRIVAL_ORDER, FACT_COLUMNS


@dataclass(frozen=True)
class WindowReplay:
    """Window results of events that went through ``watermark.replay`` with the same lateness.

    ``of`` runs and stores that replay. The on-time partials, which every result starts from, are
    stored when first asked for.

    ``fields`` are the numeric columns to aggregate. With None they are found in the events'
    ``payload_json``: ``closed``, ``open`` and ``corrections`` then count events only, and ``found_versions``
    and ``results`` tell of every field in long form, so no task holds the fields of a window until their map
    is made.
    """

    replayed: DataFrame
    windows: Windows
    fields: Sequence[str] | None
    lateness_seconds: float = 10.0
    time: str = "event_time"
    order: Sequence[str] = ARRIVAL_ORDER

    @classmethod
    def of(
        cls,
        events: DataFrame,
        windows: Windows,
        fields: Sequence[str] | None,
        lateness_seconds: float = 10.0,
        idle_timeout_seconds: float | None = None,
        time: str = "event_time",
        order: Sequence[str] = ARRIVAL_ORDER,
    ) -> WindowReplay:
        """Replay ``events``; pass only the columns needed, all of them are carried along.

        The events are stored first: a range shuffle reads its input twice, and the payload should
        be parsed once.
        """
        events = written(events, "events")
        replayed = watermark.replay(events, lateness_seconds, idle_timeout_seconds, time, order)
        return cls(written(replayed, "replayed"), windows, fields, lateness_seconds, time, order)

    @property
    def _listed(self) -> Sequence[str]:
        return self.fields or ()

    @cached_property
    def on_time(self) -> DataFrame:
        """One partial per window over the accepted, on-time events."""
        return written(self._on_time(self.replayed, self._listed), "on-time")

    def _on_time(self, rows: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
        """Partials of accepted, on-time rows by window.

        They are reduced to (pane, first window still open on arrival) before they are spread
        over windows; nearly all share the pane's own first window.
        """
        pane = self.windows.pane_of(micros(self.time))
        first = F.greatest(
            self.windows.first_start(pane), self.windows.first_open_start(micros("watermark"))
        )
        panes = (
            rows.filter(F.col("decision") == watermark.ACCEPT)
            .withColumns({"_pane": pane, "_first": first})
            .filter(F.col("_first") <= self.windows.last_start(F.col("_pane")))
            .groupBy(*keys, "_pane", "_first")
            .agg(F.count("*").alias("_n"), *field_partials(fields))
        )
        return window_partials(panes, self.windows, fields, keys, first=F.col("_first"))

    @cached_property
    def _last_watermark(self) -> Column:
        return F.lit(self.replayed.agg(F.max(micros("watermark"))).first()[0]).cast("bigint")

    def _closed_partials(self) -> DataFrame:
        return self.on_time.filter(F.col("_start") <= self._last_watermark - self.windows.size)

    def closed(self) -> DataFrame:
        """Version 0 of every window the watermark has closed."""
        return self._closed_partials().select(*self.windows.bounds("_start"), *finished(self._listed))

    def open(self) -> DataFrame:
        """Current aggregates of the windows still open."""
        return (
            self.on_time.filter(F.col("_start") > self._last_watermark - self.windows.size)
            .select(
                *self.windows.bounds("_start"),
                *finished(self._listed),
                F.lit(True).alias("is_partial"),
            )
        )

    def closed_with_time(self) -> DataFrame:
        """Version 0 results with ``emitted_at``, the arrival that closed the window."""
        closed = self._closed_partials()
        points = watermark.close_points(
            self.replayed, closed, self.windows, self.lateness_seconds, self.time, self.order
        ).select("_start", F.col(self.order[0]).alias("emitted_at"))
        return closed.join(points, "_start").select(
            *self.windows.bounds("_start"), *finished(self._listed), "emitted_at"
        )

    def _late(self) -> DataFrame:
        """One row per (late event, closed window that contains it)."""
        us = micros(self.time)
        last_closed = F.least(
            self.windows.last_start(us),
            self.windows.first_open_start(micros("watermark")) - self.windows.slide,
        )
        return (
            self.replayed.withColumns(
                {"_first": self.windows.first_start(us), "_last": last_closed}
            )
            .filter(F.col("_first") <= F.col("_last"))
            .select(
                F.explode(self.windows.starts(F.col("_first"), F.col("_last"))).alias("_start"),
                *self.order,
                F.lit(1).alias("_late"),
                F.lit(1).cast("bigint").alias("_n"),
                *[_as_partial(name, part) for name in self._listed for part in _PARTS],
            )
        )

    def _newest_only(self, late: DataFrame, closed: DataFrame) -> DataFrame:
        """Keep, per late event, the newest closed window that has a version 0."""
        known = late.join(closed.select("_start"), "_start", "left_semi")
        newest = known.groupBy(*self.order).agg(F.max("_start").alias("_start"))
        return known.join(newest, [*self.order, "_start"], "left_semi")

    def corrections(self, late_scope: str = "all") -> DataFrame:
        """Every correction with the aggregates before and after it.

        ``late_scope="all"`` corrects each closed window that contains the late event;
        ``"newest"`` only the one that starts last. Columns: window bounds,
        ``correction_version`` (1, 2, ... in arrival order), ``emitted_at``, the corrected
        aggregates, and ``previous``, a struct of the aggregates before.

        Version 0 enters the scan as the window's first row, so one ordered scan does the join
        and the running merge; a window with very many late events spans several ranges.
        """
        return self._corrections(late_scope)

    def _corrections(self, late_scope: str, places: bool = False) -> DataFrame:
        if late_scope not in ("all", "newest"):
            raise ValueError("late_scope must be 'all' or 'newest'")
        closed = self._closed_partials()
        late = self._late()
        if late_scope == "newest":
            late = self._newest_only(late, closed)
        rows = closed.withColumn("_late", F.lit(0)).unionByName(late, allowMissingColumns=True)
        ordered = OrderedRows.of(rows, ["_late", *self.order], ["_start"])
        after = {"_n": Running("sum", F.col("_n"))}
        for name in self._listed:
            for part, kind in _PARTS.items():
                column = f"_{name}_{part}"
                after[column] = Running(kind, F.col(column))
        specs = {f"_after{c}": spec for c, spec in after.items()}
        specs |= {
            f"_before{c}": Running(spec.kind, spec.value, before=True) for c, spec in after.items()
        }
        scanned = ordered.running(
            correction_version=Running("sum", F.col("_late")),
            _known=Running("max", 1 - F.col("_late")),
            **specs,
        ).filter("_late = 1 and _known = 1")
        return scanned.select(
            *self.windows.bounds("_start"),
            F.col("correction_version").cast("int").alias("correction_version"),
            F.col(self.order[0]).alias("emitted_at"),
            *(["_start", *self.order] if places else []),
            *self._state("_after"),
            F.struct(
                (F.col("correction_version") - 1).cast("int").alias("correction_version"),
                *self._state("_before"),
            ).alias("previous"),
        )

    def _state(self, prefix: str) -> list[Column]:
        """``finished`` columns computed from the prefixed partial columns."""
        out = [F.col(f"{prefix}_n").cast("bigint").alias("event_count")]
        for name in self._listed:
            at = f"{prefix}_{name}"
            out += [F.col(f"{at}_{part}").alias(f"{name}_{part}") for part in ("sum", "min", "max")]
            out.append(F.try_divide(f"{at}_sum", f"{at}_n").alias(f"{name}_avg"))
        return out

    @cached_property
    def _found(self) -> DataFrame:
        """One row per (event, numeric field of its payload)."""
        keep = [*self.order, self.time, "watermark", "decision"]
        values = payload.numeric_fields(self.replayed.select(*keep, "payload_json"), keep)
        return written(values.filter(~F.col("field").isin(FACT_COLUMNS)), "found-fields")

    def found_versions(self, late_scope: str = "all") -> DataFrame:
        """One row per (window, version, field that it holds): ``_start``, ``correction_version``, ``field``
        and the merged partial of the field, whether or not the version's event has it.

        A window's versions and the fields found in it are laid out first, which is the size of the result; the
        partials run along (window, field) in ordered ranges, so neither a window with very many late
        events nor one with very many fields meets in a task.
        """
        on_time = written(self._on_time(self._found, ["value"], ["field"]), "found-on-time")
        first = on_time.join(self._closed_partials().select("_start"), "_start", "left_semi")
        late = written(
            self._corrections(late_scope, places=True).select("_start", "correction_version", *self.order),
            "found-late",
        )
        values = self._found.select(
            *self.order, "field", *[_as_partial("value", part) for part in _PARTS]
        )
        hits = late.join(values, list(self.order)).drop(*self.order)
        rows = written(
            first.select("_start", F.lit(0).alias("correction_version"), "field", *_value_columns()).unionByName(
                hits.select("_start", "correction_version", "field", *_value_columns())
            ),
            "found-hits",
        )
        # From the version that brings a field on, every version has it.
        since = rows.groupBy("_start", "field").agg(F.min("correction_version").alias("_since"))
        slots = (
            late.select("_start", "correction_version")
            .join(since, "_start")
            .filter(F.col("correction_version") >= F.col("_since"))
            .drop("_since")
        )
        laid = rows.unionByName(slots, allowMissingColumns=True)
        laid = laid.groupBy("_start", "field", "correction_version").agg(*merged_values())
        scanned = OrderedRows.of(laid, ["correction_version"], ["_start", "field"]).running(
            **{f"_after{name}": Running(_PARTS[name.rpartition("_")[2]], F.col(name)) for name in _value_columns()}
        )
        return scanned.select(
            "_start", "correction_version", "field", *[F.col(f"_after{x}").alias(x) for x in _value_columns()]
        )

    def _found_results(self, late_scope: str) -> DataFrame:
        first = self.closed_with_time().withColumns(
            {"correction_version": F.lit(0), "_start": micros("window_start")}
        )
        versions = first.unionByName(
            self._corrections(late_scope, places=True).drop("previous", *self.order)
        )
        entries = F.array_compact(
            F.array(
                *[
                    F.when(x.isNotNull(), F.struct(F.concat_ws("_", "field", F.lit(part)).alias("key"), x.alias("value")))
                    for part, x in {
                        "avg": F.try_divide("_value_sum", "_value_n"),
                        **{part: F.col(f"_value_{part}") for part in ("max", "min", "sum")},
                    }.items()
                ]
            )
        )
        # The fields of a window meet in two stages, first by shares of them.
        keys = ["_start", "correction_version"]
        maps = (
            self.found_versions(late_scope)
            .withColumn("_salt", F.pmod(F.xxhash64("field"), F.lit(SHARES)))
            .groupBy(*keys, "_salt")
            .agg(F.flatten(F.collect_list(entries)).alias("_entries"))
            .groupBy(*keys)
            .agg(F.flatten(F.collect_list("_entries")).alias("_entries"))
        )
        count = F.struct(F.lit("count").alias("key"), F.col("event_count").cast("double").alias("value"))
        none = F.array().cast("array<struct<key: string, value: double>>")
        whole = F.concat(F.array(count), F.coalesce("_entries", none))
        return _stored_rows(
            versions.join(maps, keys, "left"), F.map_from_entries(F.array_sort(whole))
        )

    def results(self, late_scope: str = "all") -> DataFrame:
        """All versions of all closed windows in the layout of the stored table."""
        if self.fields is None:
            return self._found_results(late_scope)
        first = self.closed_with_time().withColumn("correction_version", F.lit(0))
        return result_rows(
            first.unionByName(self.corrections(late_scope).drop("previous")), self.fields
        )


_PARTS = {"sum": "sum", "min": "min", "max": "max", "n": "sum"}


def _value_columns() -> list[str]:
    return [f"_value_{part}" for part in _PARTS]


def merged_values() -> list[Column]:
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    return [merge[kind](f"_value_{part}").alias(f"_value_{part}") for part, kind in _PARTS.items()]


def _as_partial(name: str, part: str) -> Column:
    value = F.col(name).cast("double")
    inf = float("inf")
    column = {
        "sum": value,
        "min": F.when(value < F.lit(inf), value),
        "max": F.when(~F.isnan(value) & (value > F.lit(-inf)), value),
        "n": value.isNotNull().cast("bigint"),
    }[part]
    return column.alias(f"_{name}_{part}")


def result_rows(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Wide window rows in the layout of the stored table."""
    return _stored_rows(rows, aggregations(fields))


def _stored_rows(rows: DataFrame, aggregations_map: Column) -> DataFrame:
    return rows.select(
        "window_id",
        "window_start",
        "window_end",
        packed(aggregations_map).alias("aggregations_json"),
        F.col("event_count").cast("int").alias("event_count"),
        (F.col("correction_version") > 0).alias("is_correction"),
        F.col("correction_version").cast("int").alias("correction_version"),
        "emitted_at",
        F.col("emitted_at").alias("created_at"),
    )


def latest(results: DataFrame) -> DataFrame:
    """The newest correction of each window."""
    columns = [c for c in results.columns if c != "window_id"]
    return (
        results.groupBy("window_id")
        .agg(F.max_by(F.struct(*columns), "correction_version").alias("_row"))
        .select("window_id", "_row.*")
    )
