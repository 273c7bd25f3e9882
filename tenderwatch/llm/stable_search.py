"""Approximate nearest neighbours by stable projections and a kd-tree with a chi-square stopping test.

Largest inner product becomes smallest Euclidean distance by one more component: vectors get
sqrt(M^2 - |x|^2), where M is the largest norm, and queries get 0. Projections on normal vectors are
2-stable: the squared projected distance of a pair is its squared distance times a chi-square
variable with as many degrees of freedom as there are projections. So once the next projected
distance exceeds d_k * sqrt(quantile), where d_k is the distance of the k-th best verified so far,
each true neighbour has been met with at least that quantile's probability, and a query stops.

The upper levels of the kd-tree over the projections are split at medians of a bounded sample; they
deal all vectors to cells, and every block of a cell has its own lower levels. A query visits cells
in order of their projected distance, in rounds that each begin with what the last one has verified;
within a block it visits leaves in that order, with the same test. Inner products are computed on
the original vectors, in double precision and always in the order of the components.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderwatch.llm.common import Batches, in_python, shuffle_partitions
from tenderwatch.sources.storage import settle

NEIGHBOURS = 20
#: ids divisible by this are queries
EVERY = 20
#: projections, and the probability with which the stopping test has met each true neighbour
PROJECTED = 16
CHANCE = 0.95
#: vectors of each length that the upper levels are split by, at most
SAMPLE = 16384
#: vectors of a block, about; of a leaf, at most; cells for each length, at most
BLOCK = 4096
LEAF = 128
CELLS = 1024
#: queries that are sent to a block together
PACK = 1024
#: cells that a query visits in each round; the last round takes all that the test still asks for
VISITS = (1, 6)
#: relative room for rounding of inner products
_ROOM = 1e-12
_SEED = 20130


def chi_square_quantile(p: float, freedom: int) -> float:
    """The value that a chi-square variable stays below with probability ``p``."""

    def below(x: float) -> float:
        a, half = freedom / 2, x / 2
        term = total = 1 / a
        n = 1
        while term > 1e-16 * total:
            term *= half / (a + n)
            total, n = total + term, n + 1
        return total * math.exp(a * math.log(half) - half - math.lgamma(a))

    low, high = 1e-9, 10.0 * freedom + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


@dataclass(frozen=True)
class Space:
    """What all vectors of one length share: scale, largest norm, projections and upper splits."""

    dim: int
    scale: float
    norm: float
    #: dimension and value of each inner node, in heap order; left is at most the value
    axis: np.ndarray
    cut: np.ndarray

    @property
    def directions(self) -> np.ndarray:
        return np.random.default_rng(_SEED + self.dim).normal(size=(self.dim + 1, PROJECTED))

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Projections of original vectors, or of queries."""
        y = x / self.scale
        last = np.zeros(len(y)) if query else np.sqrt(np.maximum(self.norm**2 - (y * y).sum(1), 0))
        return np.hstack((y, last[:, None])) @ self.directions

    def cell(self, projected: np.ndarray) -> np.ndarray:
        at = np.zeros(len(projected), np.int64)
        rows = np.arange(len(projected))
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            at = 2 * at + 1 + (projected[rows, self.axis[at]] > self.cut[at])
        return at - len(self.axis)

    def reach(self, x: np.ndarray, best: np.ndarray, quantile: float) -> np.ndarray:
        """Squared projected distance at which queries ``x`` stop, given their k-th inner product."""
        y = x / self.scale
        d = self.norm**2 + (y * y).sum(1) - 2 * best / self.scale / self.scale
        return np.where(np.isneginf(best), np.inf, np.maximum(d, 0) * quantile * (1 + 1e-9) + 1e-12)


def split(projected: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes and medians of a complete binary tree over a sample, widest axis first."""
    axis, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = [projected]
    for node in range(len(axis)):
        some = parts[node]
        if len(some):
            axis[node] = int(np.argmax(some.max(0) - some.min(0)))
            cut[node] = np.median(some[:, axis[node]])
        side = some[:, axis[node]] > cut[node]
        parts += [some[~side], some[side]]
    return axis, cut


def leaves(projected: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree, split at medians of the widest axis."""
    done, stack = [], [np.arange(len(projected))]
    while stack:
        rows = stack.pop()
        some = projected[rows]
        wide = some.max(0) - some.min(0)
        if len(rows) <= leaf or not wide.max() > 0:
            done.append(rows)
            continue
        axis = int(wide.argmax())
        order = rows[np.argsort(some[:, axis], kind="stable")]
        stack += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


def box_distance(projected: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(projected), len(low)))
    for axis in range(projected.shape[1]):
        x = projected[:, axis, None]
        gap = np.maximum(np.maximum(low[:, axis] - x, x - high[:, axis]), 0)
        out += gap * gap
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed in the order of the components."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for i in range(a.shape[1]):
            total += a[:, i] * b[:, i]
    return np.where(np.isnan(total), -np.inf, total)


class Best:
    """The best ``k`` points of each query so far: larger score first, then smaller id."""

    def __init__(self, queries: int, k: int, score: np.ndarray):
        self.k, self.known = k, score
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.key = np.full((queries, k), -1)

    def bound(self, rows: np.ndarray) -> np.ndarray:
        """Score of the k-th best, also by what earlier rounds have verified."""
        return np.maximum(self.score[rows, -1], self.known[rows])

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray, key: np.ndarray) -> None:
        """Take in points, given as one entry per pair."""
        rows = np.unique(query)
        place = np.searchsorted(rows, query)
        old = np.repeat(np.arange(len(rows)), self.k)
        who = np.concatenate((old, place))
        s, i, y = (np.concatenate((a[rows].ravel(), b)) for a, b in ((self.score, score), (self.id, ident), (self.key, key)))
        order = np.lexsort((y, i, -s, who))
        starts = np.searchsorted(who[order], np.arange(len(rows)))
        first = (starts[:, None] + np.arange(self.k)).ravel()
        for table, values in ((self.score, s), (self.id, i), (self.key, y)):
            table[rows] = values[order][first].reshape(len(rows), self.k)


def search_block(
    space: Space,
    points: np.ndarray,
    ident: np.ndarray,
    key: np.ndarray,
    sizes: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    queries: np.ndarray,
    known: np.ndarray,
    k: int,
    quantile: float,
) -> tuple[Best, int]:
    """Search a block of points, dealt leaf by leaf, for a pack of queries; also the pairs verified."""
    ends = np.cumsum(sizes)
    near = box_distance(space.project(queries, query=True), low, high)
    order = np.argsort(near, axis=1, kind="stable")
    best = Best(len(queries), k, known)
    length, point_length = (np.sqrt((x * x).sum(1)) for x in (queries / space.scale, points / space.scale))
    room = np.float64(_ROOM * (1 + queries.shape[1])) * space.scale * space.scale
    going = np.arange(len(queries))
    verified = 0
    for step in range(len(sizes)):
        leaf = order[going, step]
        open_ = near[going, leaf] <= space.reach(queries[going], best.bound(going), quantile)
        going, leaf = going[open_], leaf[open_]  # later leaves are farther, and the reach only shrinks
        if not len(going):
            break
        for x in np.unique(leaf):
            rows, at = going[leaf == x], np.arange(ends[x] - sizes[x], ends[x])
            verified += len(rows) * len(at)
            with np.errstate(all="ignore"):
                rough = queries[rows] @ points[at].T
                enough = ~(rough + room * length[rows, None] * point_length[at] < best.bound(rows)[:, None])
            i, j = np.nonzero(enough)
            if len(i):
                best.add(rows[i], inner(queries[rows[i]], points[at[j]]), ident[at[j]], key[at[j]])
    return best, verified


# --- Spark ----------------------------------------------------------------------------------------


def usable(embedding: str = "embedding") -> Column:
    """True for vectors that take part: not NULL, every component finite, not all zero."""
    c = F.col(embedding)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def distinct_points(rows: DataFrame, k: int) -> DataFrame:
    """Stored ``key, dim, embedding, ids, first, asks`` of different vectors.

    ``ids`` are the ``k + 1`` smallest of a vector, which are all that a result can need; the ranking
    is cut in every task before rows are dealt, so a vector of very many rows costs no more. ``asks``
    tells whether any row of the vector is a query.
    """
    asking = F.col("vec_id") % EVERY == 0
    few = Window.partitionBy("embedding").orderBy("vec_id")
    ids = rows.withColumn("_place", F.row_number().over(few)).where(F.col("_place") <= k + 1).groupBy("embedding")
    ids = ids.agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asks = rows.groupBy("embedding").agg(F.max(asking).alias("asks"))
    points = ids.join(asks, "embedding").select(
        F.monotonically_increasing_id().alias("key"), F.size("embedding").alias("dim"), "embedding", "ids", F.col("ids")[0].alias("first"), "asks"
    )
    return settle(points, "points")


def _norms(batches: Batches) -> Batches:
    """Number of vectors and largest norm, per length."""
    for batch in batches:
        for dim, rows, x in _by_dim(batch, 0, 1):
            most = np.abs(x).max(1)
            norm = (most * np.sqrt(((x / most[:, None]) ** 2).sum(1))).max()
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rows)]), pa.array([norm])], ["dim", "n", "norm"])


def spaces(points: DataFrame, block: int = BLOCK) -> dict[int, Space]:
    """One space per length of vectors; at most ``SAMPLE`` vectors of each come to the driver."""
    found = {}
    sizes = in_python(points.select("dim", "embedding"), _norms, "dim int, n long, norm double")
    sizes = sizes.groupBy("dim").agg(F.sum("n").alias("n"), F.max("norm").alias("norm")).collect()
    for dim, n, norm in sorted(map(tuple, sizes)):
        norm = min(norm, np.finfo(float).max / 4)
        scale = 2.0 ** math.ceil(math.log2(norm))
        depth = max(0, min(math.ceil(math.log2(n / block)), CELLS.bit_length() - 1))
        none = np.zeros(0)
        space = Space(dim, scale, norm / scale, none.astype(np.int64), none)
        if depth:
            rows = points.where(F.col("dim") == dim).orderBy(F.xxhash64("embedding"), "key").limit(SAMPLE).select("embedding").collect()
            sample = space.project(np.array([r[0] for r in rows], np.float64))
            space = Space(dim, scale, norm / scale, *split(sample, depth))
        found[dim] = space
    return found


def _by_dim(batch: pa.RecordBatch, dim: int, embedding: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and vectors of each length in a batch."""
    dims = batch.column(dim).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        vectors = batch.column(embedding).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        out.append((int(d), rows, vectors.astype(np.float64).reshape(len(rows), int(d))))
    return out


def _deal(known: dict[int, Space]) -> Callable[[Batches], Batches]:
    """Add the cell of each vector, whose columns are key, dim, embedding and others."""

    def task(batches: Batches) -> Batches:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, rows, x in _by_dim(batch, 1, 2):
                cell[rows] = known[dim].cell(known[dim].project(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return task


_BLOCK = """dim int, cell int, part int, keys binary, firsts binary, points binary, sizes binary, low binary, high binary"""


def _grow(known: dict[int, Space]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One block: its points leaf by leaf, and the boxes of the leaves."""

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        x = np.stack(rows["embedding"])
        projected = known[key[0]].project(x.astype(np.float64))
        parts = leaves(projected)
        order = np.concatenate(parts)
        bounds = [np.stack([f(projected[p], axis=0) for p in parts]) for f in (np.min, np.max)]
        return pd.DataFrame(
            [
                {
                    "dim": key[0], "cell": key[1], "part": key[2],
                    "keys": rows["key"].to_numpy(np.int64)[order].tobytes(),
                    "firsts": rows["first"].to_numpy(np.int64)[order].tobytes(),
                    "points": x[order].tobytes(),
                    "sizes": np.array([len(p) for p in parts], np.int64).tobytes(),
                    "low": bounds[0].tobytes(), "high": bounds[1].tobytes(),
                }
            ]
        )

    return task


def _boxes(batches: Batches) -> Batches:
    """The box of each block, one row per axis."""
    for batch in batches:
        for dim, cell, low, high in zip(*(batch.column(i).to_pylist() for i in range(4))):
            least = np.frombuffer(low).reshape(-1, PROJECTED).min(0)
            most = np.frombuffer(high).reshape(-1, PROJECTED).max(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * PROJECTED, pa.int32()), pa.array([cell] * PROJECTED, pa.int32()), pa.array(range(PROJECTED), pa.int32()), pa.array(least), pa.array(most)],
                ["dim", "cell", "axis", "low", "high"],
            )


def _visits(
    known: dict[int, Space], boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], done: int, more: int | None, quantile: float
) -> Callable[[Batches], Batches]:
    """The cells that queries ``key, dim, embedding, bound`` visit next, by the stopping test."""

    def task(batches: Batches) -> Batches:
        for batch in batches:
            bound = batch.column(3).to_numpy(zero_copy_only=False)
            bound = np.where(np.isnan(bound), -np.inf, bound)
            for dim, rows, x in _by_dim(batch, 1, 2):
                cells, low, high = boxes[dim]
                near = box_distance(known[dim].project(x, query=True), low, high)
                order = np.argsort(near, axis=1, kind="stable")[:, done : None if more is None else done + more]
                at = np.arange(len(rows))[:, None]
                i, j = np.nonzero(near[at, order] <= known[dim].reach(x, bound[rows], quantile)[:, None])
                chosen = batch.take(pa.array(rows[i]))
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(cells[order[i, j]], pa.int32())], ["key", "dim", "embedding", "bound", "cell"])

    return task


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("key")
    return pd.DataFrame(
        [
            {
                "dim": key[0], "cell": key[1], "chunk": key[2],
                "asking": rows["key"].to_numpy(np.int64).tobytes(),
                "queries": np.stack(rows["embedding"]).tobytes(),
                "bounds": rows["bound"].astype(float).fillna(-np.inf).to_numpy(np.float64).tobytes(),
            }
        ]
    )


_WORK = ("dim", "asking", "queries", "bounds", "keys", "firsts", "points", "sizes", "low", "high")
_FOUND = "key long, point long, first long, score double, verified long"


def _search(known: dict[int, Space], kind: str, k: int, quantile: float) -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                v = {c: batch.column(i)[row].as_py() for i, c in enumerate(_WORK)}
                asking, keys, firsts, sizes = (np.frombuffer(v[c], np.int64) for c in ("asking", "keys", "firsts", "sizes"))
                queries, points = (np.frombuffer(v[c], kind).astype(np.float64).reshape(-1, v["dim"]) for c in ("queries", "points"))
                low, high = (np.frombuffer(v[c]).reshape(-1, PROJECTED) for c in ("low", "high"))
                best, verified = search_block(
                    known[v["dim"]], points, firsts, keys, sizes, low, high, queries, np.frombuffer(v["bounds"]), k, quantile
                )
                i, j = np.nonzero(best.key >= 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(asking[i]), pa.array(best.key[i, j]), pa.array(best.id[i, j]), pa.array(best.score[i, j]),
                        pa.array(np.where(np.arange(len(i)) == 0, verified, 0)),
                    ],
                    ["key", "point", "first", "score", "verified"],
                )

    return task


def search(points: DataFrame, k: int = NEIGHBOURS, chance: float = CHANCE, block: int = BLOCK) -> DataFrame:
    """Stored ``key, point, first, score, verified``: for each asking vector its best points found.

    At least the best ``k + 1`` of what was verified, itself included. ``verified`` adds up to the
    number of pairs whose inner product was computed.
    """
    spark = points.sparkSession
    known = spaces(points, block)
    vectors = points.schema["embedding"].dataType.simpleString()
    kind = "<f4" if vectors == "array<float>" else "<f8"
    quantile = chi_square_quantile(chance, PROJECTED)
    schema = f"key long, dim int, embedding {vectors}, first long, asks boolean, cell int"
    placed = settle(in_python(points.select("key", "dim", "embedding", "first", "asks"), _deal(known), schema), "dealt")
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).alias("parts"))
    blocks = placed.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    blocks = settle(blocks.select("key", "embedding", "first", "dim", "cell", "part").groupBy("dim", "cell", "part").applyInPandas(_grow(known), _BLOCK), "blocks")

    # one box per cell: bounded by the cells
    boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    sides = in_python(blocks.select("dim", "cell", "low", "high"), _boxes, "dim int, cell int, axis int, low double, high double")
    sides = sides.groupBy("dim", "cell", "axis").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    sides = sides.orderBy("dim", "cell", "axis").toPandas()
    for dim, some in sides.groupby("dim"):
        boxes[int(dim)] = (some["cell"].to_numpy()[::PROJECTED], *(some[c].to_numpy().reshape(-1, PROJECTED) for c in ("low", "high")))

    best_first = Window.partitionBy("key").orderBy(F.desc("score"), "first", "point")
    asking = placed.where("asks").select("key", "dim", "embedding")
    queries = asking.withColumn("bound", F.lit(None).cast("double"))
    found, done = None, 0
    for more in (*VISITS, None):
        if all(len(cells) <= done for cells, _, _ in boxes.values()):
            break
        visits = in_python(queries, _visits(known, boxes, done, more, quantile), f"key long, dim int, embedding {vectors}, bound double, cell int")
        round_ = settle(_searched(settle(visits, "visits"), blocks, known, kind, k + 1, quantile), "verified")
        found = round_ if found is None else found.unionByName(round_)
        done += more or 0
        if more is not None:
            ranked = found.withColumn("_place", F.row_number().over(best_first)).where(F.col("_place") == k + 1)
            queries = settle(asking.join(ranked.select("key", F.col("score").alias("bound")), "key", "left"), "queries")
    if found is None:
        return spark.createDataFrame([], _FOUND)
    return found


def _searched(visits: DataFrame, blocks: DataFrame, known: dict[int, Space], kind: str, k: int, quantile: float) -> DataFrame:
    """Packs of queries against every block of their cell; a cell that very many visit has many packs."""
    chunks = visits.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("chunks"))
    cut = visits.join(chunks, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    packs = settle(
        cut.select("key", "embedding", "bound", "dim", "cell", "chunk")
        .groupBy("dim", "cell", "chunk")
        .applyInPandas(_pack, "dim int, cell int, chunk int, asking binary, queries binary, bounds binary"),
        "packs",
    )
    pairs = packs.select("dim", "cell", "chunk").join(blocks.select("dim", "cell", "part"), ["dim", "cell"])
    both = (
        pairs.repartition(shuffle_partitions(visits.sparkSession), *pairs.columns)
        .join(packs, ["dim", "cell", "chunk"])
        .join(blocks, ["dim", "cell", "part"])
    )
    return in_python(both.select(*_WORK), _search(known, kind, k, quantile), _FOUND)


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, chance: float = CHANCE, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found of every query.

    Queries are the rows whose id is divisible by ``EVERY``, candidates all rows but the query's own;
    vectors of another length have no inner product with it. NULL vectors, zero vectors, those with a
    NULL or non-finite component and rows without an id take no part. Equal scores go to the smaller
    id. Rows that repeat an id or a vector are each candidates, and each asks; equal vectors are
    searched once. Products beyond double precision are infinite, and undefined ones come last. With
    fewer candidates all are returned; an empty table gives an empty result; other columns are never
    read. Every neighbour is met with a probability of ``chance`` at least.
    """
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    able = rows.where(F.col("vec_id").isNotNull() & usable())
    points = distinct_points(able, k)
    best_first = Window.partitionBy("key").orderBy(F.desc("score"), "first", "point")
    found = search(points, k, chance, block).withColumn("_place", F.row_number().over(best_first))
    # the best k + 1 vectors hold the best k + 1 rows
    hits = settle(found.where(F.col("_place") <= k + 1).select("key", "point", "score"), "hits")
    each = hits.join(points.select(F.col("key").alias("point"), "ids"), "point").select(
        "key", "score", F.explode("ids").alias("vec_id"), (F.col("key") == F.col("point")).alias("own")
    )
    by_score = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "own")
    top = each.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
    lists = settle(top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "own"))).alias("list")), "lists")

    of = points.where("asks").select("key", "embedding").join(lists, "key").drop("key")
    asked = able.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id").join(of, "embedding")
    own = F.array_position(F.transform("list", lambda e: e["own"] & (e["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("list", lambda e, i: i + 1 != F.col("own")), 1, k)
    return (
        asked.withColumn("own", own)
        .select("query_id", F.posexplode(others).alias("pos", "hit"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
    )
