"""Skew-safe building blocks: exact quantiles, first-row-wins and predecessor rows.

None of them puts an unbounded group into one task: order statistics come from
pre-aggregated histograms, copies collapse before the shuffle, and keys with very many rows
are cut into ordered slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderwatch.sources.storage import settle

#: rows of one group that a single task may sort
TASK_ROWS = 1_000_000

_LOG_STEPS = 256
_SPLITS = 4096


def _coarse_bucket(v: Column) -> Column:
    """Order-preserving logarithmic bucket, about 0.4 % wide: at most ~350,000 for all doubles."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * _LOG_STEPS)


def _rank_buckets(hist: DataFrame, part: Sequence[str], bucket: str) -> DataFrame:
    ordered = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("below", F.sum("n").over(ordered) - F.col("n"))


def exact_quantiles(
    df: DataFrame,
    group: str,
    value: str,
    probs: Sequence[float],
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles per group: ``group, n_rows, q0, q1, ...``.

    Equals ``percentile_cont``, which would gather all distinct values of a group in one task.
    Here the wanted ranks are first bracketed by a histogram with a bounded number of buckets
    per group; brackets that still hold more than ``task_rows`` rows are split again; only
    then are the few distinct values of a bracket counted and ranked. Each pass reads two
    columns and shuffles only pre-aggregated counts.
    """
    rows = df.select(
        F.col(group).alias("grp"), F.col(value).cast("double").alias("v")
    ).where("grp IS NOT NULL AND v IS NOT NULL")

    hist = rows.groupBy("grp", _coarse_bucket(F.col("v")).alias("b")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    ranked = _rank_buckets(hist, ["grp"], "b").withColumn(
        "n_rows", F.sum("n").over(Window.partitionBy("grp"))
    )
    at = [F.col("n_rows").cast("double") - 1.0] * len(probs)
    ends = []
    for i, p in enumerate(probs):
        position = at[i] * F.lit(float(p))
        for k, rank in ((2 * i, F.floor(position)), (2 * i + 1, F.ceil(position))):
            ends.append(F.struct(F.lit(k).alias("k"), rank.cast("long").alias("rank")))
    brackets = settle(
        ranked.withColumn("want", F.explode(F.array(*ends)))
        .where("below <= want.rank AND want.rank < below + n")
        .selectExpr("grp", "n_rows", "want.k AS k", "want.rank - below AS rank", "lo", "hi", "n"),
        "quantile-brackets",
    )

    while True:
        widest = brackets.where("lo < hi").agg(F.max("n")).first()[0]
        if widest is None:
            break
        brackets = settle(_narrow(rows, brackets, widest > task_rows), "quantile-brackets")

    bounds = brackets.groupBy("grp").agg(
        F.max("n_rows").alias("n_rows"),
        *[F.max(F.when(F.col("k") == k, F.col("lo"))).alias(f"x{k}") for k in range(2 * len(probs))],
    )
    out = [F.col("grp").alias(group), F.col("n_rows")]
    for i, p in enumerate(probs):
        position = (F.col("n_rows").cast("double") - 1.0) * F.lit(float(p))
        low, high = F.col(f"x{2 * i}"), F.col(f"x{2 * i + 1}")
        out.append((low + (high - low) * (position - F.floor(position))).alias(f"q{i}"))
    return bounds.select(*out)


def _narrow(rows: DataFrame, brackets: DataFrame, split: bool) -> DataFrame:
    """One refinement pass: cut open brackets into equal widths, or into distinct values."""
    key = ["grp", "lo", "hi"]
    is_open = F.col("lo") < F.col("hi")
    open_brackets = brackets.where(is_open).select(*key).distinct()
    inside = rows.join(open_brackets, "grp").where("v BETWEEN lo AND hi")
    width = (F.col("hi") - F.col("lo")) / _SPLITS
    cell = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(_SPLITS - 1))
    hist = inside.groupBy(*key, (cell if split else F.col("v")).alias("b")).agg(
        F.count("*").alias("n"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi")
    )
    ranked = _rank_buckets(hist, key, "b").withColumnRenamed("n", "new_n")
    narrowed = (
        brackets.where(is_open)
        .join(ranked, key)
        .where("below <= rank AND rank < below + new_n")
        .selectExpr("grp", "n_rows", "k", "rank - below AS rank", "new_lo AS lo", "new_hi AS hi", "new_n AS n")
    )
    return narrowed.unionByName(brackets.where(~is_open))


def first_per_key(df: DataFrame, key: str, order: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """First row of every key that is not NULL, and not among the ``stored`` ones.

    Narrow reads find the keys that occur more than once or are stored. They are written, so their size
    is known: where it is below Spark's threshold they are sent to the rows, which stay where they are,
    and else the rows move once. Only copies are aggregated whole, and they collapse on the map side, so
    a key that holds a third of all rows costs no more than any other. ``df`` is read several times:
    store it first.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    known = df.where(F.col(key).isNotNull())
    marks = known.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit(False).alias("_stored"))
    if stored is not None:
        # of a small batch the arriving keys are sent to the stored ones, which are read once, unshuffled
        met = stored.select(key).join(known.select(key), key, "left_semi").select(key, F.lit(True).alias("_stored"))
        marks = marks.unionByName(met).groupBy(key).agg(F.max("_stored").alias("_stored"))
    marks = settle(marks, "marked-keys")
    if marks.isEmpty():
        return known
    first = (
        known.join(marks.where("NOT _stored").select(key), key, "left_semi")
        .groupBy(key)
        .agg(F.min(F.struct(*order, *rest)).alias("first"))
        .select(*[F.col(key) if c == key else F.col(f"first.{c}").alias(c) for c in df.columns])
    )
    return known.join(marks.select(key), key, "left_anti").select(*df.columns).unionByName(first)


def first_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per key; rows without a key are all kept and never shuffle."""
    return first_per_key(df, key, order).unionByName(df.where(F.col(key).isNull()))


def previous_in_key(
    df: DataFrame, keys: Sequence[str], on: str, row_id: str, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Add ``prev_id`` and ``prev_on``: the row before, by (``on``, ``row_id``), within ``keys``.

    A plain LAG sorts each key in one task. Rows of keys with more than ``task_rows`` rows are
    dealt by range of (keys, ``on``, ``row_id``) and cut by rank into slices of at most
    ``task_rows`` rows, whatever the ids look like. The last row of a slice is handed to the next
    one as context, so the result equals the plain LAG.
    """
    keyed = df.withColumn("_key", F.xxhash64(*keys))
    heavy = settle(
        keyed.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > task_rows), "heavy-keys"
    )
    total = heavy.agg(F.sum("_n")).first()[0]
    if total is None:
        return _lag(df, keys, on, row_id)

    light = keyed.join(heavy, "_key", "left_anti").drop("_key")
    order = [*keys, on, row_id]
    ranged = settle(
        keyed.join(heavy, "_key", "left_semi")
        .drop("_key")
        .repartitionByRange(-(-total // task_rows), *order)
        .withColumn("_range", F.spark_partition_id()),
        "heavy-rows",
    )
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(on, row_id)) - 1
    sliced = ranged.withColumn(
        "_slice", F.struct(F.col("_range").alias("range"), F.floor(place / task_rows).alias("part"))
    ).drop("_range")
    tails = sliced.groupBy(*keys, "_slice").agg(F.max(F.struct(on, row_id)).alias("_tail"))
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    context = (
        tails.withColumn("_tail", F.lag("_tail").over(by_slice))
        .where("_tail IS NOT NULL")
        .select(*keys, "_slice", F.col(f"_tail.{on}"), F.col(f"_tail.{row_id}"), F.lit(True).alias("_context"))
    )
    both = sliced.unionByName(context, allowMissingColumns=True)
    lagged = _lag(both, [*keys, "_slice"], on, row_id).where("_context IS NULL").drop("_slice", "_context")
    return _lag(light, keys, on, row_id).unionByName(lagged).select(*df.columns, "prev_id", "prev_on")


def _lag(df: DataFrame, keys: Sequence[str], on: str, row_id: str) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(on, row_id)
    return df.withColumn("prev_id", F.lag(row_id).over(ordered)).withColumn(
        "prev_on", F.lag(on).over(ordered)
    )


