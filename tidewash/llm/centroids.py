"""Clusters around centroids; the nearest centroid by the threshold algorithm.

Each dimension has the centroids sorted by their component. From a vector's value
every dimension's list is walked outward, one centroid a round, and each centroid
that is met gets its exact distance. No centroid that is still unseen in every
list can be nearer than the sum of the lists' next squared differences, so the walk ends
when that sum strictly exceeds the best distance (strictly, so that ties are
seen and go to the smaller number). Vectors are integers and all sums exact, so the
result does not depend on the order or the partitions of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewash.functions.scratch import write_scratch
from tidewash.llm.registry import query, table
from tidewash.llm.vectors import binary, from_binary, matrix, usable

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
#: Integers per component's unit.
SCALE = 1024
SEED = 3
#: Vectors walked at once.
_ROWS = 4096
_FAR = np.int64(1) << 62


def most_component(dimensions: int) -> int:
    """The largest component for which no squared distance exceeds a long."""
    return int(((2**62) // max(1, dimensions)) ** 0.5 / 2)


class SortedCentroids:
    """The centroids' components sorted in every dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        self.order = np.argsort(self.centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(self.centroids, self.order, axis=0)
        #: Exact distances computed so far, for tests and figures.
        self.computed = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid and the squared distance."""
        numbers = np.empty(len(vectors), np.int64)
        distances = np.empty(len(vectors), np.int64)
        for begin in range(0, len(vectors), _ROWS):
            rows = slice(begin, begin + _ROWS)
            numbers[rows], distances[rows] = self._walk(vectors[rows].astype(np.int64))
        return numbers, distances

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, dimensions = self.centroids.shape
        across = np.arange(dimensions)
        number = np.full(len(vectors), count, np.int64)
        best = np.full(len(vectors), _FAR)
        seen = np.zeros((len(vectors), count), bool)
        # Places of the next centroid below and above the vector's value, in every list.
        above = np.zeros(vectors.shape, np.int64)
        for values in self.values:
            above += values < vectors
        below = above - 1
        walking = np.arange(len(vectors))
        while len(walking):
            low, high, own = below[walking], above[walking], vectors[walking]
            down = own - self.values[np.maximum(low, 0), across]
            up = self.values[np.minimum(high, count - 1), across] - own
            has_down, has_up = low >= 0, high < count
            go_down = has_down & (~has_up | (down <= up))
            frontier = np.where(go_down, down, up)
            # A list that is used up has shown every centroid.
            over = ~(has_down | has_up).all(axis=1)
            over |= (frontier * frontier).sum(axis=1) > best[walking]
            walking, go_down = walking[~over], go_down[~over]
            if not len(walking):
                break
            place = np.where(go_down, below[walking], above[walking])
            met = np.zeros((len(walking), count), bool)
            np.put_along_axis(met, self.order[place, across], True, axis=1)
            below[walking] -= go_down
            above[walking] += ~go_down
            met &= ~seen[walking]
            seen[walking] |= met
            for k in np.flatnonzero(met.any(axis=0)):
                rows = walking[met[:, k]]
                apart = vectors[rows] - self.centroids[k]
                distance = (apart * apart).sum(axis=1)
                self.computed += len(rows)
                nearer = (distance < best[rows]) | ((distance == best[rows]) & (k < number[rows]))
                best[rows[nearer]], number[rows[nearer]] = distance[nearer], k
        return number, best


def _integers(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    """``id, ints``: the vectors that are kept, scaled and floored."""
    most = most_component(dimensions)
    for batch in batches:
        lengths, firsts, flat = usable(batch.column("vector"))
        rows = np.flatnonzero(lengths == dimensions)
        scaled = np.floor(SCALE * matrix(rows, firsts, flat, dimensions))
        if len(rows) and np.abs(scaled).max(initial=0) > most:
            raise OverflowError(f"components beyond {most / SCALE:g} have no distance that fits a long")
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(rows)), binary(scaled.astype("<i4"))],
            names=["id", "ints"],
        )


def _batches(batches: Iterator[pa.RecordBatch], dimensions: int):
    for batch in batches:
        yield batch, from_binary(batch.column("ints"), "<i4", dimensions)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This part's sum of every cluster's components, and its number of vectors."""
    lists = SortedCentroids(centroids)
    count, dimensions = centroids.shape
    sums = np.zeros(centroids.shape, np.int64)
    sizes = np.zeros(count, np.int64)
    for _, vectors in _batches(batches, dimensions):
        numbers, _ = lists.nearest(vectors)
        sizes += np.bincount(numbers, minlength=count)
        for k in np.unique(numbers):
            sums[k] += vectors[numbers == k].sum(axis=0, dtype=np.int64)
    cluster, dimension = np.divmod(np.arange(sums.size), dimensions)
    used = sizes[cluster] > 0
    columns = [x[used] for x in (cluster, dimension, sums.ravel(), sizes[cluster])]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=["cluster", "dimension", "total", "n"]
    )


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    lists = SortedCentroids(centroids)
    for batch, vectors in _batches(batches, centroids.shape[1]):
        numbers, distances = lists.nearest(vectors)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(numbers, pa.int32()), pa.array(distances)],
            names=["id", "cluster", "distance"],
        )


@dataclass(frozen=True)
class Clustering:
    """``assigned`` has ``id, cluster, distance`` for every kept vector."""

    assigned: DataFrame
    centroids: np.ndarray


def integer_vectors(
    rows: DataFrame, id: str, vector: str, dimensions: int = DIMENSIONS
) -> DataFrame:
    """``id, ints`` of the vectors with exactly ``dimensions`` finite components, stored once."""
    kind = rows.schema[id].dataType.simpleString()
    kept = rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    return write_scratch(
        kept.mapInArrow(lambda b: _integers(b, dimensions), f"id {kind}, ints binary"),
        "integers",
        compression="zstd",
    )


def first_centroids(vectors: DataFrame, clusters: int, seed: int, dimensions: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order; null ids come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = vectors.orderBy(order.asc_nulls_last(), "ints").limit(clusters).collect()
    found = [np.frombuffer(r["ints"], "<i4") for r in chosen]
    return np.array(found, np.int64).reshape(len(found), dimensions)


def cluster_vectors(
    rows: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dimensions: int = DIMENSIONS,
) -> Clustering:
    """Centroids after ``rounds`` rounds, and every kept vector's nearest one.

    A round assigns all vectors, and gives every centroid that has some the
    componentwise floor of their mean. Only one sum per cluster and dimension comes
    to the driver.

    Defined results: vectors that are null, of another size, or with null or
    non-finite components are left out; fewer vectors than clusters give as many
    clusters as vectors; repeated rows count each time; equal vectors may start several
    clusters, of which the smallest number gets all; an empty table gives an empty result
    and no centroids. Components too large for a distance that fits a long raise an
    ``OverflowError``. Other columns are not looked at.
    """
    vectors = integer_vectors(rows, id, vector, dimensions)
    kind = vectors.schema["id"].dataType.simpleString()
    centroids = first_centroids(vectors, clusters, seed, dimensions)
    if not len(centroids):
        schema = StructType.fromDDL(f"id {kind}, cluster int, distance long")
        return Clustering(rows.sparkSession.createDataFrame([], schema), centroids)
    ints = vectors.select("ints")
    for _ in range(rounds):
        sums = (
            ints.mapInArrow(
                lambda b, now=centroids: _sums(b, now),
                "cluster long, dimension long, total long, n long",
            )
            .groupBy("cluster", "dimension")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
            .collect()  # at most one row per cluster and dimension
        )
        moved = centroids.copy()
        for r in sums:
            moved[r["cluster"], r["dimension"]] = r["total"] // r["n"]
        centroids = moved
    assigned = vectors.mapInArrow(
        lambda b, now=centroids: _assign(b, now), f"id {kind}, cluster int, distance long"
    )
    return Clustering(write_scratch(assigned, "assigned"), centroids)


def clustering_digest(found: Clustering, id: str = "vec_id") -> DataFrame:
    """Every vector's cluster and distance with the inertias and a hash of the centroid."""
    spark = found.assigned.sparkSession
    sums = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()
    inertia = {r["cluster"]: r["s"] for r in sums}  # a row per cluster
    rows = [
        (k, inertia.get(k, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for k, c in enumerate(found.centroids.tolist())
    ]
    report = spark.createDataFrame(
        rows, "cluster int, cluster_inertia long, centroid_sha256 string"
    )
    return found.assigned.join(F.broadcast(report), "cluster").select(
        F.col("id").alias(id),
        "cluster",
        "distance",
        "cluster_inertia",
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        "centroid_sha256",
    )


def rounds_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The query in SQL: every round is a step that compares all vectors with all centroids."""
    steps = [
        """
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
v AS MATERIALIZED (
    SELECT r, vec_id, d, CAST(floor(1024 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x
    FROM kept, range(1, 65) AS dims(d)
),
hashed AS (
    SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM kept
),
c0 AS MATERIALIZED (
    SELECT k, d, x AS c FROM v JOIN hashed USING (r) WHERE k < %d
)"""
        % clusters
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""
a{n} AS MATERIALIZED (
    SELECT r, min(struct_pack(s, k)) AS best
    FROM (SELECT r, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS s
          FROM v JOIN c{n} USING (d) GROUP BY r, k)
    GROUP BY r
)"""
        )
        if n < rounds:
            steps.append(
                f"""
c{n + 1} AS MATERIALIZED (
    SELECT k, d, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
        SELECT k, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
        FROM (SELECT best.k AS k, d, sum(x) AS s, count(*) AS n
              FROM v JOIN a{n} USING (r) GROUP BY best.k, d)
    ) USING (k, d)
)"""
            )
    return (
        ",".join(steps)
        + f""",
hashes AS (
    SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY k
)
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.s AS distance,
    CAST(sum(best.s) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
    CAST(sum(best.s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN hashes ON hashes.k = best.k
"""
    )


@query("op11_centroid_clustering", sql=rounds_sql())
def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering_digest(cluster_vectors(table(spark, folder, "embeddings")))
