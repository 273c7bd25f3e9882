"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors are compared by Euclidean distance, which falls as their cosine rises. Vectors are
dealt to blocks around pivots; each block becomes a cover tree: the root covers it within a radius
of 2, and every level halves the radius, each centre staying a centre below. Two trees, or a tree
and itself, are walked together: a pair of nodes whose centres are farther apart than both actual
covering radii and the wanted distance is pruned with all below it; one that is near enough in
whole is counted in whole; all other pairs are opened, and at the leaves cosines are computed in
double precision. Every pair of blocks that the pivots can't rule out is walked, so pairs are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderwatch.llm.common import Batches, components, forest, in_python, shuffle_partitions
from tenderwatch.sources.storage import settle

COSINE = 0.9
#: vectors of a block, about
BLOCK = 2048
#: pivots at most, and vectors that they are chosen from
PIVOTS = 512
PIVOT_SAMPLE = 4096
#: a node with fewer vectors is not split
LEAF = 48
#: room for rounding in bounds, which are in single precision; results never depend on it
SLACK = 1e-3
_STRIP = 256
#: pairs whose cosines are taken at a time
_PAIRS = 1 << 15
#: cosines this near the wanted one are computed again from the vectors as they are
_UNSURE = 1e-12
#: radii between which nodes are compared together
_RADII = (0.01, 0.1, 0.25, 0.5)


@dataclass
class Tree:
    """Nodes in arrays; the vectors of a node are a slice of the tree's order."""

    ids: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    unit: np.ndarray = field(init=False)
    center: np.ndarray = field(init=False)
    radius: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    end: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)
    children: np.ndarray = field(init=False)
    _total: np.ndarray | None = None

    def normalise(self) -> None:
        raw = self.raw.astype(np.float64)
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        self.unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))

    def build(self) -> None:
        """Net the members of each node at half its radius, its own centre first."""
        self.normalise()
        near = np.clip(self.unit.astype(np.float32) @ self.unit.astype(np.float32).T, -1, 1)
        nodes: list[list] = [[0, 2.0, np.arange(len(self.ids)), 0, 0]]
        at = 0
        while at < len(nodes):
            center, reach, members, _, _ = nodes[at]
            distance = np.sqrt(np.maximum(2 - 2 * near[center, members], 0))
            far = float(distance.max())
            nodes[at][1] = far + SLACK
            if len(members) > LEAF and far > 4 * SLACK:
                while reach > 0.9 * far:  # so that the farthest member is left out, rounding or not
                    reach /= 2
                nodes[at][3] = len(nodes)
                rest, head = members, center
                while len(rest):
                    covered = near[head, rest] >= 1 - reach * reach / 2
                    covered[rest == head] = True
                    nodes.append([int(head), reach, rest[covered], 0, 0])
                    rest = rest[~covered]
                    head = rest[0] if len(rest) else -1
                nodes[at][4] = len(nodes) - nodes[at][3]
            at += 1
        self._lay_out(nodes)

    def _lay_out(self, nodes: list[list]) -> None:
        """Order the vectors so that every node's members are a slice."""
        n = len(nodes)
        self.start, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order: list[np.ndarray] = []
        placed, stack = 0, [0]
        while stack:
            at = stack.pop()
            self.start[at] = placed
            if nodes[at][4]:
                stack.extend(range(nodes[at][3] + nodes[at][4] - 1, nodes[at][3] - 1, -1))
            else:
                order.append(nodes[at][2])
                placed += len(nodes[at][2])
        for at in range(n):
            self.end[at] = self.start[at] + len(nodes[at][2])
        by = np.concatenate(order)
        where = np.empty(len(by), np.int64)
        where[by] = np.arange(len(by))
        self.ids, self.weights, self.raw, self.unit = self.ids[by], self.weights[by], self.raw[by], self.unit[by]
        self.center = where[np.array([x[0] for x in nodes])]
        self.radius = np.array([x[1] for x in nodes], np.float64)
        self.first = np.array([x[3] for x in nodes], np.int64)
        self.children = np.array([x[4] for x in nodes], np.int64)

    _PARTS = ("ids", "weights", "center", "radius", "start", "end", "first", "children")

    def pack(self) -> dict[str, list | bytes]:
        return {k: getattr(self, k).tolist() for k in self._PARTS} | {"raw": self.raw.tobytes()}

    @classmethod
    def unpack(cls, row: dict, kind: str = "<f4") -> Tree:
        ids = np.array(row["ids"], np.int64)
        tree = cls(ids, np.array(row["weights"], np.int64), np.frombuffer(row["raw"], kind).reshape(len(ids), -1))
        for k in cls._PARTS[2:]:
            setattr(tree, k, np.array(row[k], np.float64 if k == "radius" else np.int64))
        tree.normalise()
        return tree

    @property
    def total(self) -> np.ndarray:
        """Vectors in each node, copies included."""
        if self._total is None:
            running = np.concatenate(([0], np.cumsum(self.weights)))
            self._total = running[self.end] - running[self.start]
        return self._total


_TREE = ", ".join(
    ["dim int, cell int, part int"]
    + [f"{k} array<{'double' if k == 'radius' else 'long'}>" for k in Tree._PARTS]
    + ["raw binary"]
)


class Walk:
    """The dual traversal of two trees, or of one with itself."""

    def __init__(self, a: Tree, b: Tree, cosine: float):
        self.a, self.b, self.cosine, self.same = a, b, cosine, a is b
        self.reach = float(np.sqrt(2 - 2 * cosine))
        self.counts = (np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64))
        self.one: list[np.ndarray] = []
        self.two: list[np.ndarray] = []
        self.held = 0
        #: per node, how many vectors link with all of the node
        self.whole = (np.zeros(len(a.center), np.int64), np.zeros(len(b.center), np.int64))
        self.small = (a.unit.astype(np.float32), b.unit.astype(np.float32))

    def run(self) -> None:
        stack = [*self._open(np.array([0]), np.array([0]), self.same)]
        while stack:
            p, q = stack.pop()
            ka, kb = self._opened(self.a, p), self._opened(self.b, q)
            if ka is None and kb is None:
                self._compare(*self._members(p, q), self.same and p == q)
                continue
            ka = np.array([p]) if ka is None else ka
            kb = np.array([q]) if kb is None else kb
            # Nodes of like radius go together, so that a few wide ones don't loosen the bound of all.
            for some in self._alike(self.a, ka):
                for others in self._alike(self.b, kb):
                    for at in range(0, len(some), _STRIP):
                        stack.extend(self._open(some[at : at + _STRIP], others, self.same and p == q))

    @staticmethod
    def _alike(tree: Tree, nodes: np.ndarray) -> list[np.ndarray]:
        kind = np.searchsorted(_RADII, tree.radius[nodes])
        return [nodes[kind == k] for k in np.unique(kind)]

    def _members(self, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(self.a.start[p], self.a.end[p]), np.arange(self.b.start[q], self.b.end[q])

    @staticmethod
    def _opened(tree: Tree, node: int) -> np.ndarray | None:
        first, n = tree.first[node], tree.children[node]
        return np.arange(first, first + n) if n else None

    def _open(self, ka: np.ndarray, kb: np.ndarray, own: bool) -> Iterator[tuple[int, int]]:
        """Settle pairs of these nodes, and yield those to be opened. ``own``: one set of nodes."""
        a, b = self.a, self.b
        near = self.small[0][a.center[ka]] @ self.small[1][b.center[kb]].T
        ra, rb = a.radius[ka], b.radius[kb]
        widest = np.minimum(ra + rb.max() + self.reach + SLACK, 2.0)
        i, j = np.nonzero(near >= (1 - widest * widest / 2 - SLACK)[:, None])
        if own:
            i, j = i[ka[i] <= kb[j]], j[ka[i] <= kb[j]]
        distance = np.sqrt(np.maximum(2 - 2 * near[i, j].astype(np.float64), 0))
        spread = ra[i] + rb[j]
        # The square root blows up the rounding of a product near 1, hence the wider room inside.
        kept = distance <= spread + self.reach + 2 * SLACK
        inside = distance + spread + 2 * SLACK <= self.reach
        p, q, inside = ka[i[kept]], kb[j[kept]], inside[kept]
        if self.same:
            inside[p == q] = 2 * a.radius[p[p == q]] + 2 * SLACK <= self.reach
        leaves = (a.children[p] == 0) & (b.children[q] == 0) & ~inside
        if self.same:
            leaves &= p != q
        self._count_whole(p[inside], q[inside])
        yield from zip(p[~inside & ~leaves].tolist(), q[~inside & ~leaves].tolist())
        if leaves.any():
            self._compare_leaves(p[leaves], q[leaves])

    @staticmethod
    def _inner(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of some nodes, and which of the nodes each belongs to."""
        sizes = tree.end[nodes] - tree.start[nodes]
        of = np.repeat(np.arange(len(nodes)), sizes)
        return np.arange(sizes.sum()) + (tree.start[nodes] - np.cumsum(sizes) + sizes)[of], of

    def _compare_leaves(self, p: np.ndarray, q: np.ndarray) -> None:
        """The vectors of pairs of leaves: in single precision together, then the near ones in double."""
        (ps, at_p), (qs, at_q) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
        paired = np.zeros((len(ps), len(qs)), bool)
        paired[at_p, at_q] = True
        (rows, of), (columns, to) = self._inner(self.a, ps), self._inner(self.b, qs)
        least = self.cosine - 1e-4 - 2e-7 * self.a.unit.shape[1]
        others = self.small[1][columns]
        for at in range(0, len(rows), _STRIP):
            strip = rows[at : at + _STRIP]
            i, j = np.nonzero(self.small[0][strip] @ others.T >= least)
            met = paired[of[at + i], to[j]]
            i, j = strip[i[met]], columns[j[met]]
            for some in range(0, len(i), _PAIRS):
                x, y = i[some : some + _PAIRS], j[some : some + _PAIRS]
                self._settle(x, y, np.einsum("ij,ij->i", self.a.unit[x], self.b.unit[y]))

    def _count_whole(self, p: np.ndarray, q: np.ndarray) -> None:
        """All vectors of each ``p`` link with all of its ``q``."""
        own = (p == q) if self.same else np.zeros(len(p), bool)
        np.add.at(self.whole[0], p, self.b.total[q])
        np.add.at(self.whole[0] if self.same else self.whole[1], q[~own], self.a.total[p[~own]])
        for x in np.unique(p[own]).tolist():  # a vector does not link with itself
            part = slice(self.a.start[x], self.a.end[x])
            self.counts[0][part] -= self.a.weights[part]
        self._link(self.a.ids[self.a.center[p]], self.b.ids[self.b.center[q]])

    def _spread(self) -> None:
        """Hand what holds for whole nodes down to their vectors."""
        for tree, counts, whole in zip((self.a, self.b), self.counts, self.whole):
            for x in np.nonzero(whole)[0].tolist():
                part = slice(tree.start[x], tree.end[x])
                counts[part] += whole[x]
                self._link(tree.ids[part], np.full(part.stop - part.start, tree.ids[tree.center[x]]))

    def _link(self, one: np.ndarray, two: np.ndarray) -> None:
        if not len(one):
            return
        self.one.append(one)
        self.two.append(two)
        self.held += len(one)
        if self.held > 1 << 20:
            x, y = forest(np.concatenate(self.one), np.concatenate(self.two))
            self.one, self.two, self.held = [x], [y], len(x)

    def _compare(self, rows: np.ndarray, columns: np.ndarray, own: bool = False) -> None:
        """Cosines of two sets of vectors in double precision."""
        near = self.a.unit[rows] @ self.b.unit[columns].T
        close = near >= self.cosine - _UNSURE
        i, j = np.nonzero(np.triu(close, 1) if own else close)
        self._settle(rows[i], columns[j], near[i, j])

    def _settle(self, i: np.ndarray, j: np.ndarray, near: np.ndarray) -> None:
        """Link the pairs of vectors whose cosines, nearly ``near``, are large enough."""
        a, b = self.a, self.b
        linked = near >= self.cosine
        for at in np.flatnonzero(np.abs(near - self.cosine) < _UNSURE):
            # by a power of two, which changes no digit and lets no product overflow
            u, v = (np.ldexp(x, -np.frexp(np.abs(x).max())[1]) for x in (a.raw[i[at]].astype(np.float64), b.raw[j[at]].astype(np.float64)))
            linked[at] = np.dot(u, v) / (np.sqrt(np.dot(u, u)) * np.sqrt(np.dot(v, v))) >= self.cosine
        i, j = i[linked], j[linked]
        if len(i):
            np.add.at(self.counts[0], i, b.weights[j])
            np.add.at(self.counts[0] if self.same else self.counts[1], j, a.weights[i])
            self._link(a.ids[i], b.ids[j])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Linked vectors with their counts, and a forest of links."""
        self._spread()
        ids, counts = self.a.ids, self.counts[0]
        if not self.same:
            ids, counts = np.concatenate((ids, self.b.ids)), np.concatenate(self.counts)
        one, two = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.one, self.two))
        one, two = forest(one, two) if len(one) else (one, two)
        return ids[counts > 0], counts[counts > 0], one, two


def usable(embedding: str = "embedding") -> Column:
    """True for vectors that can link: not NULL, every component finite, not all zero."""
    c = F.col(embedding)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _pivots(points: DataFrame, block: int) -> dict[int, np.ndarray]:
    """Unit pivots of each dimension, spread out over a bounded sample by farthest-first choice."""
    sizes = {r["dim"]: r["count"] for r in points.groupBy("dim").count().collect()}
    chosen = {}
    for dim, n in sorted(sizes.items()):
        rows = points.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE)
        x = np.array([r[0] for r in rows.select("embedding").collect()], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        picked, best = [0], x @ x[0]
        while len(picked) < min(PIVOTS, len(x), -(-n // (2 * block))):
            picked.append(int(np.argmin(best)))
            best = np.maximum(best, x @ x[picked[-1]])
        chosen[dim] = x[picked]
    return chosen


def _assign(pivots: dict[int, np.ndarray]):
    def task(batches: Batches) -> Batches:
        for batch in batches:
            dims = batch.column(1).to_pylist()
            cell, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for row, (dim, vector) in enumerate(zip(dims, batch.column(2))):
                v = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                v = v / np.abs(v).max()
                near = pivots[dim] @ (v / np.sqrt(v @ v))
                cell[row] = np.argmax(near)
                away[row] = np.sqrt(max(0.0, 2 - 2 * near[cell[row]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(cell), pa.array(away)],
                ["id", "dim", "embedding", "weight", "cell", "away"],
            )

    return task


def _grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    tree = Tree(
        rows["id"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64), np.stack(rows["embedding"])
    )
    tree.build()
    return pd.DataFrame([{"dim": key[0], "cell": key[1], "part": key[2]} | tree.pack()])


def _walk(cosine: float, kind: str):
    names = [*Tree._PARTS, "raw"]

    def task(batches: Batches) -> Batches:
        for batch in batches:
            n = len(names)
            for row in range(batch.num_rows):
                values = [batch.column(i)[row].as_py() for i in range(n)]
                a = Tree.unpack(dict(zip(names, values)), kind)
                if batch.column(2 * n)[row].as_py():
                    b = a
                else:
                    b = Tree.unpack(dict(zip(names, [batch.column(n + i)[row].as_py() for i in range(n)])), kind)
                walk = Walk(a, b, cosine)
                walk.run()
                ids, counts, one, two = walk.found()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((ids, one)), pa.int64()),
                        pa.array([None] * len(ids) + two.tolist(), pa.int64()),
                        pa.array(np.concatenate((counts, np.zeros(len(one), np.int64))), pa.int64()),
                    ],
                    ["a", "b", "n"],
                )

    return task


def _cell_pairs(placed: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """``dim, cell_a, cell``: pairs of cells that the pivots can't rule out; bounded by the pivots."""
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    radii: dict[tuple[int, int], float] = {
        (r["dim"], r["cell"]): r["far"] for r in placed.groupBy("dim", "cell").agg(F.max("away").alias("far")).collect()
    }
    rows = []
    for dim, x in pivots.items():
        far = np.array([radii.get((dim, c), -1.0) for c in range(len(x))])
        apart = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0))
        meet = (apart <= far[:, None] + far[None, :] + reach) & (far[:, None] >= 0) & (far[None, :] >= 0)
        rows += [(dim, int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(meet)))]
    return placed.sparkSession.createDataFrame(rows, "dim int, cell_a int, cell int")


def pair_work(points: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``a, b, n`` over a stored table of different vectors ``id, dim, embedding, weight``.

    Rows without ``b`` say that ``a`` links to ``n`` other vectors in some pair of blocks; the
    others are links enough to connect all that is linked.
    """
    spark = points.sparkSession
    pivots = _pivots(points, block)
    vectors = points.schema["embedding"].dataType.simpleString()
    schema = f"id long, dim int, embedding {vectors}, weight long, cell int, away double"
    placed = settle(in_python(points, _assign(pivots), schema), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
    blocks = placed.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    trees = settle(
        blocks.select("id", "embedding", "weight", "dim", "cell", "part").groupBy("dim", "cell", "part").applyInPandas(_grow, _TREE),
        "trees",
    )
    names = trees.select("dim", "cell", "part")
    left = trees.select("dim", *[F.col(c).alias(f"{c}_a") for c in trees.columns if c != "dim"])
    pairs = (
        _cell_pairs(placed, pivots, cosine)
        .join(names.select("dim", F.col("cell").alias("cell_a"), F.col("part").alias("part_a")), ["dim", "cell_a"])
        .join(names, ["dim", "cell"])
        .where("cell_a < cell OR part_a <= part")
    )
    both = (
        pairs.repartition(shuffle_partitions(spark), *pairs.columns)
        .join(left, ["dim", "cell_a", "part_a"])
        .join(trees, ["dim", "cell", "part"])
    )
    order = [*Tree._PARTS, "raw"]
    both = both.select(
        *[f"{c}_a" for c in order], *order, F.expr("cell_a = cell AND part_a = part").alias("same")
    )
    return settle(in_python(both, _walk(cosine, "<f4" if vectors == "array<float>" else "<f8"), "a long, b long, n long"), "pair-work")


def near_groups(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Two vectors of the same length link when their cosine, in double precision, is at least
    ``cosine``. NULL vectors, zero vectors and those with a NULL or non-finite component link with
    nothing. Equal vectors collapse to one with their number before any comparison. ``component_id``
    is the smallest ``vec_id`` that links reach, and that row is kept. A row without ``vec_id`` links
    with nothing and has no component. Rows that repeat an id each count. An empty table gives an
    empty result; other columns are never read.
    """
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = embeddings.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    able = rows.where(F.col("vec_id").isNotNull() & usable())
    points = settle(
        able.groupBy("embedding")
        .agg(F.min("vec_id").cast("long").alias("first"), F.count(F.lit(1)).alias("weight"))
        .select(F.monotonically_increasing_id().alias("id"), F.size("embedding").alias("dim"), "embedding", "weight", "first"),
        "points",
    )
    # a vector, not an id, is a point: rows that repeat an id may have different vectors
    work = pair_work(points.drop("first"), cosine, block)
    counts = work.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    tied = components(work.where("b IS NOT NULL").select("a", "b"))
    linked_points = settle(
        points.join(counts, "id", "left")
        .join(tied.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "embedding",
            "first",
            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("group"),
        ),
        "linked-points",
    )
    smallest = settle(linked_points.groupBy("group").agg(F.min("first").alias("component_id")), "smallest-ids")
    of = linked_points.join(smallest, "group").select("embedding", "n_links", "component_id")
    linked = able.join(settle(of, "vector-groups"), "embedding").drop("embedding")
    alone = rows.where(~(F.col("vec_id").isNotNull() & usable())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
