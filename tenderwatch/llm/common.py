"""What several training-data operators share: reading, numbering, graph components."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenderwatch.sources.storage import settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


#: applications whose executors have been given this package
_SHIPPED: set[str] = set()

Batches = Iterator[pa.RecordBatch]


def in_python(df: DataFrame, task: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df.mapInArrow``, with this package sent to the executors' Python once per application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/tenderwatch", "zip", root, "tenderwatch")
        context.addPyFile(made)
        _SHIPPED.add(context.applicationId)
    return df.mapInArrow(task, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(stored: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the row's place in its group, from 0 without a gap, by ``order``.

    A ranking window over ``group`` would sort a whole group in one task. Here the rows are dealt
    by range of (group, order), so a large group spreads over many tasks; each task ranks its own
    rows, and only the counts per (range, group) are summed up over a group. ``stored`` is a
    stored table of narrow rows: dealing by range reads it twice. Equal rows get some order.
    """
    ranged = settle(
        stored.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range", *group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    ranked = ranged.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(offsets, ["_range", *group])
        .withColumn(name, F.col("_before") + F.col("_rank"))
        .select(*stored.columns, name)
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node each node of ``edges (a, b)`` can reach.

    Alternating large-star and small-star steps over a table of edges that is written anew after
    every round; nothing but two sums per round comes to the driver. Every step is a minimum per
    node with map-side combining and a join, so a node with very many neighbours is split by the
    skew handling of adaptive execution.
    """
    now = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen, now = state, settle(_small_star(_large_star(now)), "edges")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links ``a[i], b[i]`` as one link to the smallest value of each component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y, root[x], root[y]):
            np.minimum.at(new, end, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]
