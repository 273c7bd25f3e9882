"""Clustering around centroids in integers, with bounds that spare most distances.

Every vector keeps, for each centroid, the distance at which it last saw it and in which round that
was. The history of all centroids is kept too, so a bound is loosened by how far the centroid is from
where it was then (the norm of its total displacement), not by the sum of the steps in between, which
is never less. Where the loosened bounds can't show that the own centroid is still the nearest, the
distances in doubt, and only these, are computed again, exactly.

A round is one pass without a shuffle over a stored table, and one sum per centroid; what comes to
the driver is the centroids themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderwatch.llm.common import Batches, in_python
from tenderwatch.sources.storage import settle

COMPONENTS = 64
CENTROIDS = 16
ROUNDS = 3
#: a component becomes floor(SCALE * x)
SCALE = 64
#: components beyond this are held at it, so that no squared distance passes a long
FARTHEST = 1 << 27
#: up to this size double precision adds products of 64 components exactly
_EXACT = 1 << 20
_MOST = (1 << 63) - 1


def scaled(embedding: str = "embedding", components: int = COMPONENTS) -> Column:
    """The integer components; NULL where the vector takes no part."""
    c = F.col(embedding)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    edge = float(FARTHEST)
    whole = F.transform(c, lambda v: F.floor(F.least(F.greatest(v.cast("double") * SCALE, F.lit(-edge)), F.lit(edge))).cast("int"))
    return F.when((F.size(c) == components) & finite, whole)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows, one by one."""
    d = x.astype(np.int64) - c
    return (d * d).sum(1)


def all_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all ``x`` to all ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        u, v = x.astype(np.float64), c.astype(np.float64)
        return ((u * u).sum(1)[:, None] - 2 * (u @ v.T) + (v * v).sum(1)).astype(np.int64)
    return np.stack([squared(x, row) for row in c], 1)


def first_seen(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, distances, the round they are of, and how many were computed."""
    d = all_squared(x, c)
    return d.argmin(1), np.sqrt(d.astype(np.float64)), np.zeros(d.shape, np.int8), np.full(len(x), len(c))


def reassigned(
    x: np.ndarray, cluster: np.ndarray, far: np.ndarray, seen: np.ndarray, history: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after centroids have moved; ``history[r]`` are the centroids of round ``r``."""
    now, k = len(history) - 1, history.shape[1]
    c = history[now]
    moved = np.sqrt(((history - c).astype(np.float64) ** 2).sum(2))
    shift = moved[seen, np.arange(k)]
    room = 1e-9 + 1e-12 * (far + shift)  # for rounding of roots
    rows = np.arange(len(x))
    low = far - shift - room
    low[rows, cluster] = np.inf
    high = (far + shift + room)[rows, cluster]
    cluster, far, seen = cluster.copy(), far.copy(), seen.copy()
    checked = np.zeros(len(x), np.int64)

    at = np.flatnonzero(low.min(1) <= high)
    mine = cluster[at]
    own = squared(x[at], c[mine])
    far[at, mine], seen[at, mine] = np.sqrt(own.astype(np.float64)), now
    doubt = low[at] <= (far[at, mine] * (1 + 1e-12) + 1e-9)[:, None]
    row, j = np.nonzero(doubt)
    again = squared(x[at[row]], c[j])
    far[at[row], j], seen[at[row], j] = np.sqrt(again.astype(np.float64)), now
    # all others are farther than the own centroid for certain
    near = np.full((len(at), k), _MOST)
    near[np.arange(len(at)), mine] = own
    near[row, j] = again
    cluster[at] = near.argmin(1)
    checked[at] = 1 + doubt.sum(1)
    return cluster, far, seen, checked


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1), kind))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


_STATE = "x array<int>, cluster int, far array<double>, seen array<tinyint>, checked long"


def _round(history: np.ndarray) -> Callable[[Batches], Batches]:
    """Assign every vector to the nearest of the newest centroids, by what it knows of earlier ones."""

    def task(batches: Batches) -> Batches:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(1), n)
            if len(history) == 1:
                cluster, far, seen, checked = first_seen(x, history[0])
            else:
                known = (batch.column(2).to_numpy(zero_copy_only=False), _matrix(batch.column(3), n), _matrix(batch.column(4), n))
                cluster, far, seen, checked = reassigned(x, *known, history)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), _lists(far, pa.float64()),
                    _lists(seen.astype(np.int8), pa.int8()), pa.array(checked, pa.int64()),
                ],
                ["vec_id", "x", "cluster", "far", "seen", "checked"],
            )

    return task


def _distances(centroids: np.ndarray) -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column(2).to_numpy(zero_copy_only=False)
                d = squared(_matrix(batch.column(1), batch.num_rows), centroids[cluster])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return task


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``1:<vec_id>``; equal hashes by components."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(len(rows), -1)


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each centroid's vectors; one without vectors stays."""
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return new


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """State after the last assignment, and the history of centroids, of stored ``vec_id, x``.

    ``checked`` of the state is the number of distances that the last pass computed for a vector.
    """
    history = first_centroids(vectors, k)[None]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    state = vectors
    for step in range(rounds + 1):
        if step:
            history = np.concatenate((history, moved_centroids(state, history[-1])[None]))
        state = settle(in_python(state, _round(history), f"vec_id {kind}, {_STATE}"), f"assigned-{step}")
    return state, history


def centroid_clusters(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of exactly 64 components, none NULL or non-finite; all others give no row.
    Equal distances go to the smaller centroid. Rows that repeat an id or a vector each count and
    each come back. A row without ``vec_id`` is clustered, but starts a centroid only if there are
    too few others. With fewer than ``k`` kept vectors there are as many centroids. Components beyond
    ``FARTHEST`` are held at it, and sums beyond a long at its largest value. An empty table gives an
    empty result; other columns are never read.
    """
    spark = embeddings.sparkSession
    vectors = settle(embeddings.select("vec_id", scaled().alias("x")).where("x IS NOT NULL"), "integer-vectors")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if vectors.isEmpty():
        return spark.createDataFrame(
            [], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    state, history = clustered(vectors, k, rounds)
    last = history[-1]
    near = settle(in_python(state, _distances(last), f"vec_id {kind}, cluster int, distance long"), "distances")
    sums = {r["cluster"]: int(r["d"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(sum(sums.values()), _MOST)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in last]
    about = spark.createDataFrame(
        [(j, min(d, _MOST), whole, digest[j]) for j, d in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # one row per centroid
    return near.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
