"""Centroid clustering with geometric drift tightening, exact over integers.

Each vector keeps an upper bound of its distance to its own centroid and a lower bound of its distance to every
other one. When centroids move, the lower bound would have to fall by the largest drift. Instead each cluster is
seen as the sphere around its centroid that holds its vectors. For another centroid that moves from p to q, only
the plane through the sphere's centre, p and q matters: in it, the largest loss of distance that a point of the
sphere can see is found from the sphere's place relative to the line p q, and it is less than the drift unless
the sphere reaches the line ahead of q. Vectors whose bounds still leave room for doubt are scanned exactly.

All distances are squared sums of integers, so results depend on nothing but the rows. Bounds are doubles and
are widened by more than their rounding. A round is one pass over the stored rows; only centroids, sums and
radii (a number per cluster and dimension) meet on the driver, after being added up by Spark.

Defined results: vectors with null or non-finite entries or another number of components are dropped. Rows that
repeat an id are rows of their own; a row with a null id is clustered but never an initial centroid unless there
are too few others. With fewer rows than clusters there are as many clusters as rows; an empty table gives an
empty table. Extra columns and clashing names do not matter. Entries of 2^26 and more after scaling are refused,
as squared distances might not fit a long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.session import cut

SCALE = 64
DIMENSION = 64
CLUSTERS = 16
ROUNDS = 3
BLOCK = 4_096
LARGEST = 2**26
# Relative widening of bounds, far above the rounding of a few operations on doubles.
WIDEN = 1e-9
# Parts of a drift over which the largest cosine is taken as constant.
STEPS = 64


def vectors_of(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(id, x) of the vectors that can be used, x being their integer components."""
    v = F.col("v")
    given = vectors.select(vectors[id].alias("id"), vectors[vector].cast("array<double>").alias("v"))
    finite = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    usable = given.filter((F.size(v) == dimension) & finite)
    small = F.when(F.exists(v, lambda c: F.abs(c) * scale >= LARGEST), F.raise_error("a component is too large")).otherwise(v)
    return usable.select("id", F.transform(small, lambda c: F.floor(c * scale).cast("int")).alias("x"))


def initial(rows: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The rows of smallest hash of their id, in that order; the components decide between equal hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(clusters)
    return np.array([row["x"] for row in first.collect()], dtype=np.int64)


def plane_loss(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """The most by which a point within ``radius`` of ``centre`` can come nearer when ``old`` moves to ``new``.

    In the plane through the three points let the drift run along the first axis from (0, 0) to (D, 0) and the
    centre be at (a, h). On the way a point comes nearer at the rate of the cosine of the angle at which it is
    seen, so the loss is at most the sum of the largest cosines of the disc; it never exceeds the drift D.
    """
    move = new - old
    drift = float(np.linalg.norm(move))
    if drift == 0:
        return 0.0
    to_centre = centre - old
    a = float(to_centre @ move) / drift
    h = math.sqrt(max(float(to_centre @ to_centre) - a * a, 0.0))
    if radius >= h:  # the sphere reaches the line
        reach = a + math.sqrt(max(radius * radius - h * h, 0.0))
        if reach >= drift:
            return drift

    def largest_cosine(s: float) -> float:
        """Of the angle between the drift and the nearest tangent to the disc, seen from (s, 0)."""
        distance = math.hypot(a - s, h)
        if distance <= radius:
            return 1.0
        angle = math.atan2(h, a - s) - math.asin(min(radius / distance, 1.0))
        return math.cos(max(angle, 0.0))

    # Every point falls behind along the way, so the largest cosine never rises and left ends are a bound.
    bound = sum(largest_cosine(drift * i / STEPS) for i in range(STEPS)) / STEPS * drift
    return min(drift, bound)


def losses(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster the most its vectors' lower bounds must fall when the other centroids move."""
    k = len(old)
    found = np.zeros(k)
    for own in range(k):
        lost = [plane_loss(old[own].astype(float), radii[own], old[j].astype(float), new[j].astype(float)) for j in range(k) if j != own]
        found[own] = max([0.0, *lost]) * (1 + WIDEN)
    return found


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one column per centroid."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) by comparing with every centroid; the smaller number wins a tie."""
    squares = squared_distances(x, centroids)
    cluster = squares.argmin(axis=1)
    nearest = squares[np.arange(len(x)), cluster]
    squares[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
    second = squares.min(axis=1) if len(centroids) > 1 else np.full(len(x), np.iinfo(np.int64).max)
    return cluster, np.sqrt(nearest) * (1 + WIDEN), np.sqrt(second.astype(np.float64)) * (1 - WIDEN)


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray,
             drifts: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New (cluster, upper, lower) after the centroids moved, and how many vectors were scanned."""
    upper = (upper + drifts[cluster]) * (1 + WIDEN)
    lower = np.maximum(lower - lost[cluster], 0.0) * (1 - WIDEN)
    doubt = np.flatnonzero(upper >= lower)
    # The exact distance to the own centroid settles many before the others are looked at.
    own = np.sqrt(((x[doubt] - centroids[cluster[doubt]]) ** 2).sum(axis=1)) * (1 + WIDEN)
    upper[doubt] = own
    doubt = doubt[own >= lower[doubt]]
    cluster = cluster.copy()
    if len(doubt):
        cluster[doubt], upper[doubt], lower[doubt] = scan(x[doubt], centroids)
    return cluster, upper, lower, len(doubt)


def _components(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _assigned(state: DataFrame, step) -> DataFrame:
    """State rows (id, x, cluster, upper, lower, scanned) with the last four made by ``step``."""
    schema = T.StructType([state.schema["id"], state.schema["x"], T.StructField("cluster", T.IntegerType()),
                           T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                cluster, upper, lower = step(_components(part.column(1)), *(c.to_numpy(zero_copy_only=False) for c in part.columns[2:]))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], names=schema.names)

    return state.mapInArrow(run, schema)


def moments(state: DataFrame, clusters: int) -> tuple[dict[tuple[int, int], int], dict[int, int], dict[int, float]]:
    """Sums by (cluster, dimension), counts and radii by cluster, added up in tasks and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        radii: dict[int, float] = {}
        for batch in batches:
            x, cluster, upper = _components(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for c in np.unique(cluster).tolist():
                own = cluster == c
                added = np.append(x[own].sum(axis=0), own.sum())
                sums[c] = sums[c] + added if c in sums else added
                radii[c] = max(radii.get(c, 0.0), float(upper[own].max()))
        for c, total in sums.items():
            d = len(total)
            yield pa.record_batch([pa.array([c] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(total), pa.array([radii[c]] * d)],
                                  names=["cluster", "at", "total", "radius"])

    partial = state.select("x", "cluster", "upper").mapInArrow(run, "cluster int, at int, total bigint, radius double")
    exact = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    rows = partial.groupBy("cluster", "at").agg(exact, F.max("radius").alias("radius")).collect()
    last = max((row["at"] for row in rows), default=0)
    return (
        {(r["cluster"], r["at"]): int(r["total"]) for r in rows if r["at"] < last},
        {r["cluster"]: int(r["total"]) for r in rows if r["at"] == last},
        {r["cluster"]: r["radius"] for r in rows},
    )


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], int], counts: dict[int, int]) -> np.ndarray:
    """Centroids after a round: exact floors of means, the old one where a cluster is empty."""
    after = centroids.copy()
    for c, n in counts.items():
        after[c] = [sums[c, i] // n for i in range(centroids.shape[1])]
    return after


def cluster(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            seed: int = 1, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that can be used."""
    rows = cut(vectors_of(vectors, id, vector, dimension, scale), "vectors")
    centroids = initial(rows, clusters, seed)
    schema = "cluster int, upper double, lower double"
    blank = rows.select("id", "x", *[F.lit(0).cast(t).alias(n) for n, t in (c.split(" ") for c in schema.split(", "))])
    if not len(centroids):
        nothing = [("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
        return blank.select(F.col("id").alias(id), "cluster", *[F.lit(None).cast(t).alias(n) for n, t in nothing])
    first = centroids
    state = cut(_assigned(blank, lambda x, *_: scan(x, first)), "clusters")
    for step in range(rounds):
        sums, counts, radii = moments(state, clusters)
        after = moved(centroids, sums, counts)
        drifts = np.sqrt(((after - centroids) ** 2).sum(axis=1)) * (1 + WIDEN)
        lost = losses(centroids, after, np.array([radii.get(c, 0.0) for c in range(len(centroids))]))
        centroids = after

        def settle(x, own, upper, lower, centroids=centroids, drifts=drifts, lost=lost):
            return reassign(x, own, upper, lower, centroids, drifts, lost)[:3]

        state = cut(_assigned(state, settle), "clusters")
    return _with_inertia(state, centroids, id)


def _with_inertia(state: DataFrame, centroids: np.ndarray, id: str) -> DataFrame:
    last = F.array(*[F.array(*[F.lit(int(v)) for v in c]) for c in centroids])
    gap = F.zip_with("x", F.element_at(last, F.col("cluster") + 1), lambda a, b: (a - b).cast("long") * (a - b).cast("long"))
    placed = state.select("id", "cluster", F.aggregate(gap, F.lit(0).cast("long"), lambda s, d: s + d).alias("distance"))
    per_cluster = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return placed.select(
        F.col("id").alias(id), "cluster", "distance",
        of([per_cluster.get(c, 0) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(per_cluster.values())).cast("bigint").alias("inertia"),
        of(names, "string").alias("centroid_sha256"),
    )
