"""The dimension as a standing table that change batches are merged into.

A key's state is what is left of its changes: the winning upsert and the last delete (see
``operators.dimension``). States lie in buckets by the hash of their key; a batch is reduced to the states of
its own keys first and stored as a delta. When ``max_deltas`` deltas have gathered, they are folded
into the buckets that they touch, and only those are read and written. The manifest names the folder of each
bucket and the deltas that are not folded yet; it is replaced whole, by number, so a reader
holds on to one manifest and never sees half a merge. Folders that no recent manifest names are removed by
``vacuum``.

A batch that is run again finds itself in the manifest and changes nothing, or writes the same folders anew.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import dimension
from tidemark.plans.durable import folders, read_text, remove, write_text
from tidemark.plans.sizing import BROADCAST_BYTES, measured_bytes

_STORED = T.StructType([*dimension.STATE.fields, T.StructField("bucket", T.IntegerType())])


@dataclass(frozen=True)
class Manifest:
    """Which folders make up the table."""

    number: int = -1
    last_batch: int = -1
    buckets: dict[int, str] = field(default_factory=dict)
    deltas: list[tuple[str, list[int]]] = field(default_factory=list)  # folder, its buckets

    def text(self) -> str:
        return json.dumps([self.number, self.last_batch, sorted(self.buckets.items()), self.deltas])

    @classmethod
    def of(cls, text: str) -> Manifest:
        number, last, buckets, deltas = json.loads(text)
        return cls(number, last, {int(b): folder for b, folder in buckets}, [(x, y) for x, y in deltas])


class DimensionTable:
    """A table under ``root``; call it for its rows, as ``Flow.dimension`` does.

    ``n_buckets`` is fixed with the first batch: choose it so that a bucket holds about a million keys.
    """

    def __init__(self, spark: SparkSession, root: str, n_buckets: int = 64, max_deltas: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.n_buckets, self.max_deltas = n_buckets, max_deltas

    # -- reading -------------------------------------------------------------------------------

    def manifest(self) -> Manifest:
        """The newest manifest."""
        newest = max(self._numbers(), default=None)
        return Manifest() if newest is None else Manifest.of(read_text(self.spark, self._manifest_path(newest)))

    def __call__(self, spark: SparkSession | None = None) -> DataFrame:
        return self.table()

    def version(self, spark: SparkSession | None = None) -> int:
        """A number that changes with the table."""
        return max(self._numbers(), default=-1)

    def table(self, manifest: Manifest | None = None) -> DataFrame:
        """The rows of the table, inactive ones too, in the layout of ``dimension.replay``."""
        return dimension.from_states(self.states(manifest or self.manifest()))

    def states(self, manifest: Manifest) -> DataFrame:
        """One state for each key. Keys that only the base holds are read as they lie; those of the deltas
        are folded with what the base has of them."""
        base = self._read(manifest.buckets.values())
        if not manifest.deltas:
            return base.drop("bucket")
        deltas = self._read(folder for folder, _ in manifest.deltas)
        changed = deltas.select("bucket", "dimension_key").distinct()
        small = measured_bytes(changed) <= BROADCAST_BYTES
        changed = changed.toDF("_bucket", "_key")
        if small:
            # The base stays where it is: only its rows of changed keys are shuffled.
            changed = F.broadcast(changed)
        same = (F.col("bucket") == F.col("_bucket")) & F.col("dimension_key").eqNullSafe(F.col("_key"))
        folded = dimension.fold_states(base.join(changed, same, "left_semi").unionByName(deltas).drop("bucket"))
        return base.join(changed, same, "left_anti").drop("bucket").unionByName(folded)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys (``dimension_key``), read from their buckets only."""
        manifest = self.manifest()
        wanted = keys.select("dimension_key").distinct()
        touched = self._touched(wanted.select(self._bucket().alias("bucket")))
        part = Manifest(
            manifest.number,
            manifest.last_batch,
            {b: folder for b, folder in manifest.buckets.items() if b in touched},
            [(folder, own) for folder, own in manifest.deltas if touched & set(own)],
        )
        return self.table(part).join(wanted, "dimension_key", "left_semi")

    # -- writing -------------------------------------------------------------------------------

    def start(self, changes: DataFrame, **trigger) -> StreamingQuery:
        """Merge a stream of changes, batch by batch."""
        return (
            changes.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """Merge one batch of changes; batches come in order of their ids."""
        manifest = self.manifest()
        if batch_id <= manifest.last_batch:
            return
        folder = f"{self.root}/delta/batch={batch_id}"
        reduced = dimension.fold_states(dimension.as_states(changes)).withColumn("bucket", self._bucket())
        self._write(reduced, folder)
        touched = self._touched(self._read([folder]).select("bucket"))
        deltas = [*manifest.deltas, *([(folder, sorted(touched))] if touched else [])]
        buckets = dict(manifest.buckets)
        if len(deltas) > self.max_deltas:
            merged = {b for _, own in deltas for b in own}
            target = f"{self.root}/base/batch={batch_id}"
            parts = [buckets[b] for b in sorted(merged) if b in buckets] + [x for x, _ in deltas]
            self._write(self._merged(parts), target)
            buckets |= {b: f"{target}/bucket={b}" for b in merged}
            deltas = []
        after = Manifest(manifest.number + 1, batch_id, buckets, deltas)
        write_text(self.spark, self._manifest_path(after.number), after.text())

    def _merged(self, parts: Sequence[str]) -> DataFrame:
        """The states in some folders folded by key; a key lies in one bucket wherever it lies."""
        return dimension.fold_states(self._read(parts).drop("bucket")).withColumn("bucket", self._bucket())

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests but the newest ``keep`` and the folders that none of these names; returns how many
        folders went."""
        numbers = sorted(self._numbers())
        named: set[str] = set()
        for number in numbers[-keep:]:
            manifest = Manifest.of(read_text(self.spark, self._manifest_path(number)))
            named |= {_tail(x) for x in [*manifest.buckets.values(), *(folder for folder, _ in manifest.deltas)]}
        for number in numbers[:-keep]:
            remove(self.spark, self._manifest_path(number))
        found = folders(self.spark, f"{self.root}/base/batch=*/bucket=*")
        found += folders(self.spark, f"{self.root}/delta/batch=*")
        gone = [x for x in found if _tail(x) not in named]
        for path in gone:
            remove(self.spark, path)
        return len(gone)

    # -- inner ---------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("dimension_key"), F.lit(self.n_buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        """Bucket numbers, of which there are ``n_buckets`` at most."""
        return {row["bucket"] for row in rows.distinct().collect()}

    def _read(self, paths: Sequence[str]) -> DataFrame:
        """Stored states from some folders; a bucket's folder tells its number by its name."""
        paths = list(paths)
        if not paths:
            return self.spark.createDataFrame([], _STORED)
        rows = self.spark.read.schema(dimension.STATE).option("recursiveFileLookup", True).parquet(*paths)
        return rows.withColumn("bucket", self._bucket())

    def _write(self, states: DataFrame, path: str) -> None:
        (
            states.hint("rebalance", "bucket")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(path)
        )

    def _manifest_path(self, number: int) -> str:
        return f"{self.root}/manifest/{number:012d}.json"

    def _numbers(self) -> list[int]:
        found = (re.search(r"(\d+)\.json$", x) for x in folders(self.spark, f"{self.root}/manifest/*.json"))
        return [int(x[1]) for x in found if x]


def _tail(path: str) -> str:
    """A folder's name below the root, however the file system writes the root."""
    return re.search(r"(base/batch=\d+/bucket=\d+|delta/batch=\d+)/?$", path)[1]
