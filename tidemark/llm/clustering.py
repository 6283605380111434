"""Exact centroid clustering over a vector-approximation file.

Vectors are whole numbers. Beside each lies its approximation: for each dimension the number of one of 64
cells, six bits, and the vector's distance from the middle of its cells. For the centroids of a round,
lookup tables hold what each cell of each dimension adds to the distance between that middle and each centroid.
With the stored distance this is an interval for each centroid. Since all intervals are of one and the
same vector, the gap between two of them is known more closely than either: it cannot differ from the
gap seen from the middle by more than twice the stored distance times the distance of the two centroids. Where the
nearest one stays ahead of all others, the vector is settled; the rest need their full values.

Vectors are stored in zones, by how far they lie from the border of their first cluster. A round
reads the approximations alone, to learn which zones hold a vector that is not settled or has changed
its cluster; only their vectors are read in full. Settled vectors that stay where they are leave the sums of their clusters as
they are, so sums are carried on by what moves. Each pass is a scan without a join or a shuffle of rows and
keeps nothing from round to round but the centroids: which cluster a vector had is told by the centroids
before. Sums are exact whole numbers; the driver holds centroids, cell borders and sums, whose size depends
on dimensions and clusters only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import binary
from tidemark.plans.durable import remove, scratch_path, written

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
CELLS = 64
# Cells are as wide as if a normal distribution so many times wider were to fill them evenly.
WIDER = 1.7
# Distances from the border of a first cluster at which zones end, in vectors' distances from their cells' middles.
ZONES = (1, 2, 3, 4, 6, 8, 12)
# Values from here on have distances that a long cannot hold.
LIMIT = 1 << 26
# Cluster number of a vector that its approximation leaves open.
OPEN = -1


def _whole_batches(source: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, list of floats) to (vec_id, values): floor(scale * x) in 32 bits each."""
    for batch in source:
        if not batch.num_rows:
            continue
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        scaled = np.floor(flat * scale)
        if np.abs(scaled).max() >= LIMIT:
            raise ValueError(f"a component is {LIMIT // scale} or more: squared distances do not fit a long")
        values = scaled.astype(np.int32).reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), binary(values)], ["vec_id", "values"])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return raw.view(kind).reshape(len(column), -1)


def _spread_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum, sum of squares, least and greatest value of each dimension in a batch."""
    for batch in source:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0), np.int32).astype(np.float64)
        columns = [
            np.arange(x.shape[1], dtype=np.int32),
            np.full(x.shape[1], float(len(x))),
            x.sum(0),
            (x * x).sum(0),
            x.min(0),
            x.max(0),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "n", "s", "q", "low", "high"])


def borders(vectors: DataFrame) -> np.ndarray:
    """For each dimension the ends of its cells: cell k holds the values from end k to end k + 1.

    The outer cells reach to the least and the greatest value. Which values a cell holds decides how many
    vectors are settled, never the outcome.
    """
    found = (
        vectors.select("values")
        .mapInArrow(_spread_batches, "dim int, n double, s double, q double, low double, high double")
        .groupBy("dim")
        .agg(F.sum("n"), F.sum("s"), F.sum("q"), F.min("low"), F.max("high"))
        .orderBy("dim")
        .collect()
    )
    _, n, s, q, low, high = np.array([tuple(row) for row in found], np.float64).T
    mean = s / n
    spread = WIDER * np.sqrt(np.maximum(q / n - mean * mean, 0))
    quantiles = np.array([NormalDist().inv_cdf(k / CELLS) for k in range(1, CELLS)])
    inner = np.round(mean[:, None] + spread[:, None] * quantiles)
    inner = np.clip(inner, low[:, None], high[:, None] + 1)
    return np.hstack((low[:, None], inner, high[:, None] + 1)).astype(np.int64)


def packed(cells: np.ndarray) -> np.ndarray:
    """Four cells of six bits in three bytes."""
    c = np.pad(cells, ((0, 0), (0, -cells.shape[1] % 4))).reshape(len(cells), -1, 4)
    out = np.empty((*c.shape[:2], 3), np.uint8)
    out[..., 0] = c[..., 0] << 2 | c[..., 1] >> 4
    out[..., 1] = (c[..., 1] & 15) << 4 | c[..., 2] >> 2
    out[..., 2] = (c[..., 2] & 3) << 6 | c[..., 3]
    return out.reshape(len(cells), -1)


def unpacked(raw: np.ndarray, dimensions: int) -> np.ndarray:
    b = raw.reshape(len(raw), -1, 3)
    out = np.empty((*b.shape[:2], 4), np.uint8)
    out[..., 0] = b[..., 0] >> 2
    out[..., 1] = (b[..., 0] & 3) << 4 | b[..., 1] >> 4
    out[..., 2] = (b[..., 1] & 15) << 2 | b[..., 2] >> 6
    out[..., 3] = b[..., 2] & 63
    return out.reshape(len(raw), -1)[:, :dimensions]


def middles(ends: np.ndarray) -> np.ndarray:
    """Twice the middle of each cell, a whole number."""
    return ends[:, :-1] + np.maximum(ends[:, 1:] - 1, ends[:, :-1])


def approximated(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each vector, and twice its distance from their middle, rounded up."""
    cells = np.empty(values.shape, np.uint8)
    apart = np.zeros(len(values), np.int64)
    twice = middles(ends)
    for d in range(values.shape[1]):
        cells[:, d] = np.searchsorted(ends[d, 1:-1], values[:, d], "right")
        apart += (2 * values[:, d].astype(np.int64) - twice[d][cells[:, d]]) ** 2
    return cells, np.nextafter(np.sqrt(apart).astype(np.float32), np.float32(np.inf))


def distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    whole = values.astype(np.int64)
    return np.stack([((whole - c) ** 2).sum(1) for c in centroids], axis=1)


def settled(cells: np.ndarray, radius: np.ndarray, ends: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid where the approximation tells it, else ``OPEN``."""
    table = (middles(ends)[:, :, None] - 2 * centroids.T[:, None, :]) ** 2
    apart = np.zeros((len(cells), len(centroids)), np.int64)
    for d in range(len(ends)):
        apart += table[d][cells[:, d]]
    best = apart.argmin(1)
    rows = np.arange(len(cells))
    between = 2 * np.sqrt(distances(centroids, centroids).astype(np.float64))
    ahead = (apart - apart[rows, best][:, None]).astype(np.float64)
    # A little more than the bound makes up for rounding.
    sure = ahead > 2 * radius.astype(np.float64)[:, None] * between[best] * (1 + 1e-9) + 1
    # Itself, and centroids equal to it, of which it has the smallest number.
    sure |= between[best] == 0
    return np.where(sure.all(1), best, OPEN)


def nearest(values: np.ndarray, known: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """``known`` with its open places filled from the vectors; of equally near ones the smaller number."""
    out = known.copy()
    rest = np.flatnonzero(known == OPEN)
    out[rest] = distances(values[rest], centroids).argmin(1)
    return out


def zones(values: np.ndarray, radius: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the zone of each vector by its distance from the border of its cluster."""
    apart = distances(values, centroids).astype(np.float64)
    best = apart.argmin(1)
    rows = np.arange(len(values))
    between = np.sqrt(distances(centroids, centroids).astype(np.float64))
    margin = (apart - apart[rows, best][:, None]) / np.maximum(2 * between[best], 1)
    margin[between[best] == 0] = np.inf
    return np.searchsorted(np.array(ZONES, np.float64), margin.min(1) / np.maximum(radius / 2, 1), "right")


@dataclass
class Clustering:
    """Exact rounds over stored ``vectors``: vec_id, values, cells, radius and zone, one folder a zone."""

    vectors: DataFrame
    ends: np.ndarray
    centroids: np.ndarray
    before: np.ndarray | None = None
    read: list[list[int]] = field(default_factory=list)  # zones that each round read in full

    def __post_init__(self):
        self.sums = np.zeros((len(self.centroids), self.centroids.shape[1] + 1), object)

    def step(self) -> None:
        """Assign every vector to its nearest centroid, then move the centroids."""
        needed = self.open_zones()
        self.read.append(needed)
        for row in self._changes(needed).groupBy("cluster", "dim").agg(F.sum("change").alias("change")).collect():
            self.sums[row["cluster"], row["dim"] + 1] += int(row["change"])
        self.before = self.centroids.copy()
        for i, (count, *sums) in enumerate(self.sums.tolist()):
            if count:
                self.centroids[i] = [total // count for total in sums]

    def _told(self, cells: pa.Array, radius: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
        """What the approximations tell of the clusters by these centroids and by those before."""
        own = unpacked(_matrix(cells, np.uint8), len(self.ends))
        apart = radius.to_numpy()
        new = settled(own, apart, self.ends, self.centroids)
        return new, None if self.before is None else settled(own, apart, self.ends, self.before)

    def _helper(self) -> Clustering:
        """The numbers of this round for the tasks, without the table."""
        before = None if self.before is None else self.before.copy()
        return Clustering(None, self.ends, self.centroids.copy(), before)

    def open_zones(self) -> list[int]:
        """Zones with a vector whose cluster is not settled or not the one before; the first round takes all."""
        if self.before is None:
            return list(range(len(ZONES) + 1))
        told = self._helper()._told

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                if batch.num_rows:
                    new, old = told(batch.column(0), batch.column(1))
                    some = (new == OPEN) | (new != old)
                    zone = np.unique(batch.column(2).to_numpy()[some]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(zone)], ["zone"])

        found = self.vectors.select("cells", "radius", "zone").mapInArrow(batches, "zone int").distinct()
        return sorted(row["zone"] for row in found.collect())

    def _changes(self, needed: Sequence[int]) -> DataFrame:
        """cluster, dim, change: what the vectors of these zones change in the sums; dim -1 counts vectors."""
        helper = self._helper()

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                if not batch.num_rows:
                    continue
                new, old = helper._told(batch.column(0), batch.column(1))
                rows = np.arange(len(new)) if old is None else np.flatnonzero((new == OPEN) | (new != old))
                values = _matrix(batch.column(2), np.int32)[rows]
                whole = np.hstack((np.ones((len(rows), 1), np.int64), values.astype(np.int64)))
                change = np.zeros((len(helper.centroids), whole.shape[1]), np.int64)
                np.add.at(change, nearest(values, new[rows], helper.centroids), whole)
                if old is not None:
                    np.subtract.at(change, nearest(values, old[rows], helper.before), whole)
                at, dim = np.nonzero(change)
                columns = [at.astype(np.int32), dim.astype(np.int32) - 1, change[at, dim]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cluster", "dim", "change"])

        rows = self.vectors.filter(F.col("zone").isin(list(needed))).select("cells", "radius", "values")
        found = rows.mapInArrow(batches, "cluster int, dim int, change long")
        return found.withColumn("change", F.col("change").cast("decimal(38,0)"))

    def result(self) -> DataFrame:
        """vec_id, cluster, distance by the centroids as they stand."""
        helper = self._helper()
        helper.before = None

        def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                if batch.num_rows:
                    values = _matrix(batch.column(3), np.int32)
                    own = nearest(values, helper._told(batch.column(1), batch.column(2))[0], helper.centroids)
                    apart = ((values.astype(np.int64) - helper.centroids[own]) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(own, pa.int32()), pa.array(apart)],
                        ["vec_id", "cluster", "distance"],
                    )

        return self.vectors.select("vec_id", "cells", "radius", "values").mapInArrow(
            batches, "vec_id long, cluster int, distance long"
        )


def kept_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and values (32 bits each, binary) of the vectors that have all their components."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    whole = x.isNotNull() & (F.size(x) == dimensions) & F.forall(x, finite)
    rows = embeddings.filter(F.coalesce(whole, F.lit(False)))
    return rows.select(F.col("vec_id").cast("bigint"), x.alias("embedding")).mapInArrow(
        lambda source: _whole_batches(source, scale), "vec_id long, values binary"
    )


STORED = "vec_id long, values binary, cells binary, radius float"


def clustering(
    embeddings: DataFrame,
    clusters: int = CLUSTERS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> Clustering | None:
    """Stored vectors with their approximations and the first centroids; None without vectors."""
    spark = embeddings.sparkSession
    plain, path = scratch_path(spark, "vectors"), scratch_path(spark, "vectors-cells")
    kept_vectors(embeddings, dimensions, scale).write.parquet(plain)
    vectors = spark.read.schema("vec_id long, values binary").parquet(plain)
    dealt = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(dealt.asc_nulls_last(), "values").limit(clusters).collect()
    if not first:
        return None
    ends = borders(vectors)
    centroids = np.array([np.frombuffer(row["values"], np.int32) for row in first], np.int64)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                values = _matrix(batch.column(1), np.int32)
                cells, radius = approximated(values, ends)
                zone = zones(values, radius, centroids).astype(np.int32)
                columns = [*batch.columns, binary(packed(cells)), pa.array(radius), pa.array(zone)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "values", "cells", "radius", "zone"])

    vectors.mapInArrow(batches, f"{STORED}, zone int").write.partitionBy("zone").parquet(path)
    remove(spark, plain)
    return Clustering(spark.read.schema(f"{STORED}, zone int").parquet(path), ends, centroids.copy())


RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
)


def clustered(embeddings: DataFrame, rounds: int = ROUNDS, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each kept vector.

    A vector is kept if it has ``dimensions`` components, none of them null, not a number or infinite. Rows
    that repeat a vec_id are vectors of their own, and so are rows without one, which are no first centroid unless
    there are too few others. Fewer vectors than clusters give fewer clusters; extra columns are ignored; an
    empty table gives an empty result. A component of 2^16 or more in absolute value is an error.
    """
    state = clustering(embeddings, **options)
    if state is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    for _ in range(rounds):
        state.step()
    found = written(state.result(), "clustered")
    totals = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    whole = sum(row["cluster_inertia"] for row in totals)
    table = [
        (
            row["cluster"],
            row["cluster_inertia"],
            whole,
            hashlib.sha256(",".join(map(str, state.centroids[row["cluster"]].tolist())).encode()).hexdigest(),
        )
        for row in totals
    ]
    # One row for each cluster.
    lookup = embeddings.sparkSession.createDataFrame(
        table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(lookup), "cluster").select(*[x.split()[0] for x in RESULT.split(", ")])


def _rounds_sql() -> str:
    """Each round's nearest centroids and the centroids after it."""
    parts = []
    for r in range(ROUNDS + 1):
        parts.append(f"""
near{r} AS MATERIALIZED (
  SELECT id, vec_id, arg_min(cluster, (apart, cluster)) AS cluster, min(apart) AS distance FROM (
    SELECT id, vec_id, cluster, sum((x - y) * (x - y))::BIGINT AS apart
    FROM v JOIN c{r} USING (dim) GROUP BY id, vec_id, cluster) GROUP BY id, vec_id)""")
        parts.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT cluster, dim, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS y
  FROM c{r} LEFT JOIN (
    SELECT cluster, dim, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN near{r} USING (id)
    GROUP BY cluster, dim) USING (cluster, dim))""")
    return ",".join(parts[:-1])


SQL = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT)
    AS xs FROM embeddings WHERE len(embedding) = {DIMENSIONS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
v AS MATERIALIZED (
  SELECT id, vec_id, unnest(range({DIMENSIONS})) AS dim, unnest(xs) AS x FROM e),
c0 AS MATERIALIZED (
  SELECT (n - 1)::INT AS cluster, unnest(range({DIMENSIONS})) AS dim, unnest(xs) AS y FROM (
    SELECT xs, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, xs) AS n FROM e)
  WHERE n <= {CLUSTERS}),{_rounds_sql()},
t AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near{ROUNDS} GROUP BY cluster),
h AS (SELECT cluster, sha256(string_agg(y, ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM t)::BIGINT AS inertia,
  centroid_sha256
FROM near{ROUNDS} JOIN t USING (cluster) JOIN h USING (cluster)
"""
