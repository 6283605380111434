"""As-of enrichment of a live stream: each fact with the dimension state of its own moment.

Facts and changes are two streams in one stateful operator. A fact waits until the watermark, the
lesser one of both streams, has passed its moment; by then every change of that moment is known. It then takes what
the changes up to its moment leave of its key (``operators.dimension``): the winning upsert, unless a delete came
after it. A change at the very moment counts. Changes are kept only until they are folded into
the key's state, facts until they are joined.

Keys lie in buckets by their hash; a state is that of a bucket, so a batch asks for as many states as there are
buckets. A bucket is cut into ``PARTS`` by more of the hash: what waits in a part is kept in chunks, each under its
earliest moment, and what its keys have come to as one table. So the state store is asked once for a chunk, not
for a row or key, only for chunks whose moments have come, and a task holds the rows of one part. Facts are dealt to ``salts`` copies of
their bucket by their place in the topic, and every change goes to each copy, so that a key with a
third of all facts does not wait in one task.

A change that comes after the watermark has passed its moment is folded when it comes, so it counts for
facts that are still waiting; a fact that comes so late takes the state that the watermark has reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.schemas import ARRIVAL_ORDER

JOINED = "body string, attributes_json string, version long"
_CHANGE, _DELETE, _FACT = 0, 1, 2
# Parts of a bucket, and rows that are gathered before they are dealt over the parts.
PARTS = 64
GATHERED = 200_000
_ROWS = pa.schema(
    [
        ("part", pa.int32()),
        ("at", pa.int64()),
        ("side", pa.int32()),
        ("key", pa.string()),
        ("version", pa.int64()),
        ("seq", pa.int64()),
        ("body", pa.string()),
    ]
)
_STATES = pa.schema(
    [("key", pa.string()), ("version", pa.int64()), ("seq", pa.int64()), ("body", pa.string()), ("deleted", pa.int64())]
)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(blob)).read_all()


class AsOf(StatefulProcessor):
    """Keys (bucket, salt); pending facts and changes, and the state of each key that the watermark has reached."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "part int, number long, earliest long", "rows binary")
        self.folded = handle.getMapState("folded", "part int", "states binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number = 1 + max((x[1] for x in self.pending.keys()), default=-1)
        earliest, gathered, count = None, [], 0
        for frame in rows:
            if not len(frame):
                continue
            gathered.append(pa.Table.from_pandas(frame[_ROWS.names], _ROWS, preserve_index=False))
            first = int(frame["at"].min())
            earliest = first if earliest is None else min(earliest, first)
            count += len(frame)
            if count >= GATHERED:
                self._add(pa.concat_tables(gathered), number)
                number, gathered, count = number + 1, [], 0
        if gathered:
            self._add(pa.concat_tables(gathered), number)
        # A moment is over once the watermark is beyond it. One timer for the earliest is enough: it asks
        # for the next.
        if earliest is not None:
            self.handle.registerTimer(earliest + 1)
        yield self._frame([])

    def _add(self, rows: pa.Table, number: int) -> None:
        rows = rows.sort_by([("part", "ascending"), ("at", "ascending")])
        part = rows["part"].to_numpy()
        begins = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(part)]):
            own = rows.slice(begin, end - begin)
            self.pending.updateValue((int(part[begin]), number, own["at"][0].as_py()), (_packed(own),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((int(x[0]), int(x[1]), int(x[2])) for x in self.pending.keys())
        ripe: dict[int, list[tuple[int, int, int]]] = {}
        for place in waiting:
            if place[2] < watermark:
                ripe.setdefault(place[0], []).append(place)
        left = [place[2] for place in waiting if place[2] >= watermark]
        for part, places in ripe.items():
            rows = pa.concat_tables([_unpacked(self.pending.getValue(place)[0]) for place in places])
            rows = rows.sort_by([("at", "ascending"), ("side", "ascending")])
            due = int(np.searchsorted(rows["at"].to_numpy(), watermark))
            for place in places:
                self.pending.removeKey(place)
            if due < rows.num_rows:
                rest = rows.slice(due)
                left.append(rest["at"][0].as_py())
                self.pending.updateValue((part, places[0][1], left[-1]), (_packed(rest),))
            yield self._frame(self._joined(part, rows.slice(0, due)))
        if left:
            self.handle.registerTimer(min(left) + 1)
        if not ripe:
            yield self._frame([])

    def _joined(self, part: int, due: pa.Table) -> list[tuple]:
        """Facts of a part with the state of their keys, and the states as the changes among the rows leave them."""
        states: dict[str, list] = {}
        if self.folded.containsKey((part,)):
            columns = _unpacked(self.folded.getValue((part,))[0]).columns
            states = {own: state for own, *state in zip(*[x.to_pylist() for x in columns])}
        changed, out = False, []
        for side, own, version, seq, body in zip(*[due[x].to_pylist() for x in _ROWS.names[2:]]):
            state = states.get(own)
            if side == _FACT:
                live = state is not None and state[0] is not None and (state[3] is None or state[3] < state[1])
                out.append((body, state[2] if live else None, state[0] if live else None))
                continue
            changed = True
            if state is None:
                state = states[own] = [None, None, None, None]
            if side == _DELETE:
                state[3] = seq if state[3] is None else max(state[3], seq)
            elif state[0] is None or (version, -seq) > (state[0], -state[1]):
                state[:3] = version, seq, body
        if changed:
            columns = [list(states), *([state[i] for state in states.values()] for i in range(4))]
            self.folded.updateValue((part,), (_packed(pa.table(columns, schema=_STATES)),))
        return out

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["body", "attributes_json", "version"])
        return frame.astype({"version": "Int64"})


def enrich_as_of(
    facts: DataFrame,
    changes: DataFrame,
    fact_time: str,
    change_time: str,
    delay: str = "0 seconds",
    buckets: int = 64,
    salts: int = 4,
) -> DataFrame:
    """Streams of facts and changes to a stream of facts with ``attributes_json`` and ``version``.

    ``fact_time`` and ``change_time`` are comparable timestamps, to the millisecond; ``delay`` is how far out of
    order either stream may be. Both columns are null where the key is unknown or deleted at that moment. A fact
    without a time or key is not joined. ``buckets`` times ``salts`` states are what the work is dealt over. Facts need the columns of ``ARRIVAL_ORDER``, which tell
    them apart.
    """
    upsert = (F.col("op") == "upsert") & (F.col("version") > 0)
    none = F.lit(None)
    known = changes.withWatermark(change_time, delay).filter(upsert | (F.col("op") == "delete"))
    waiting = facts.withWatermark(fact_time, delay)

    def row(key: Column, salt: Column, at: str, side: Column, version: Column, seq: Column, body: Column):
        place = F.pmod(F.xxhash64(key), F.lit(buckets * PARTS))
        return [
            F.pmod(place, F.lit(buckets)).cast("int").alias("bucket"), salt.alias("salt"),
            F.floor(place / buckets).cast("int").alias("part"),
            key.alias("key"), F.unix_millis(at).alias("at"), side.cast("int").alias("side"), version.cast("bigint").alias("version"),
            seq.cast("bigint").alias("seq"), body.cast("string").alias("body"),
        ]

    one = known.select(
        *row(
            F.col("dimension_key"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))),
            change_time,
            F.when(upsert, _CHANGE).otherwise(_DELETE),
            F.col("version"),
            F.col("seq"),
            F.col("attributes_json"),
        )
    )
    two = waiting.select(
        *row(
            F.col("join_key"),
            F.pmod(F.xxhash64(*ARRIVAL_ORDER), F.lit(salts)).cast("int"),
            fact_time,
            F.lit(_FACT),
            none,
            none,
            F.to_json(F.struct("*")),
        )
    )
    rows = one.unionByName(two).filter("at is not null and key is not null")
    joined = rows.groupBy("bucket", "salt").transformWithStateInPandas(
        statefulProcessor=AsOf(), outputStructType=JOINED, outputMode="Append", timeMode="EventTime"
    )
    schema = facts.schema
    return joined.select(F.from_json("body", schema).alias("_fact"), "attributes_json", "version").select(
        "_fact.*", "attributes_json", "version"
    )
