"""Exact deduplication with an extendible-hash index on shared files.

Texts are keyed by a 64-bit hash. The index holds one entry per key; a directory of 2^depth slots
leads from the first ``depth`` bits of a key to its bucket, and doubles until no bucket holds more
than ``BUCKET_KEYS`` keys. A bucket that fits with fewer bits is shared by several slots. Every
bucket is written by the one task that owns it. Texts whose keys collide are chained: their bytes
are compared, and each different text of a key has its place in the chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderwatch.llm.common import ascii_lower
from tenderwatch.sources.storage import settle

#: keys in a bucket, about 200 KB in a file
BUCKET_KEYS = 4096
#: bits of a key that the directory may use; beyond these a bucket can only chain
MAX_DEPTH = 48


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def normalised(c: Column) -> Column:
    return ascii_lower(F.coalesce(c, F.lit("")))


def _slot(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> tuple[DataFrame, int]:
    """``slot, bucket_depth, bucket`` of every used slot, and the depth of the directory.

    ``keys`` is a stored table with one row per ``key``. Depth starts from the number of keys and
    doubles the directory while a bucket is overfull; counts stay in Spark, one number comes back.
    """
    total = keys.count()
    depth = max(0, (max(total, 1) - 1) // bucket_keys).bit_length()
    while depth < MAX_DEPTH:
        fullest = keys.groupBy(_slot(F.col("key"), depth).alias("slot")).count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= bucket_keys:
            break
        depth += 1
    slots = keys.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    tried = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
    prefix = F.expr(f"shiftright(slot, {depth} - bits)")
    fits = tried.groupBy("bits", prefix.alias("bucket")).agg(F.sum("n").alias("n")).where(
        (F.col("n") <= bucket_keys) | (F.col("bits") == depth)
    )
    chosen = (
        slots.select("slot", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
        .withColumn("bucket", prefix)
        .join(fits.drop("n"), ["bits", "bucket"], "left_semi")
        .groupBy("slot")
        .agg(F.min(F.struct("bits", "bucket")).alias("b"))
        .select("slot", F.col("b.bits").alias("bucket_depth"), F.col("b.bucket").alias("bucket"))
    )
    return settle(chosen, "directory"), depth


def build_index(entries: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The stored index: ``bucket_depth, bucket, key, n_rows, keep_id`` with one row per key.

    Copies are counted before they are dealt out, so a key that a third of all rows share costs no
    more than another; a task owns whole buckets.
    """
    keys = settle(
        entries.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.max("doc_id").alias("keep_id")), "keys"
    )
    slots, depth = directory(keys, bucket_keys)
    owned = (
        keys.withColumn("slot", _slot(F.col("key"), depth))
        .join(slots, "slot")
        .drop("slot")
        .repartition("bucket_depth", "bucket")
        .sortWithinPartitions("bucket_depth", "bucket", "key")
    )
    return settle(owned.select("bucket_depth", "bucket", "key", "n_rows", "keep_id"), "index")


def exact_groups(
    docs: DataFrame,
    key_of: Callable[[Column], Column] = text_key,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """Which row stays of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; NULL counts as empty. The row
    with the largest ``doc_id`` stays. One row per document comes back, and rows that repeat both
    id and text share one verdict. A NULL ``doc_id`` stays only where its group has no other id.
    An empty table gives an empty result; other columns are never read.
    """
    entries = settle(
        docs.select("doc_id", normalised(F.col("text")).alias("text")).select(
            "doc_id", key_of(F.col("text")).alias("key"), F.unhex(F.sha2("text", 256)).alias("sha")
        ),
        "entries",
    )
    index = build_index(entries, bucket_keys)
    shared = settle(index.where("n_rows > 1").select("key"), "shared-keys")
    chains = settle(
        docs.select("doc_id", normalised(F.col("text")).alias("text"))
        .withColumn("key", key_of(F.col("text")))
        .join(shared, "key", "left_semi")
        .groupBy("text")
        .agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n_rows"), F.max("doc_id").alias("keep_id"))
        .select("key", F.unhex(F.sha2("text", 256)).alias("sha"), "n_rows", "keep_id", "text")
        .drop("text"),
        "chains",
    )
    # A key in two or more chains is a collision: its rows are told apart by text.
    chained = Window.partitionBy("key")
    links = chains.withColumn("chain", F.count(F.lit(1)).over(chained))
    collided = links.where("chain > 1").select("key", "sha", "n_rows", "keep_id")
    by_key = index.join(collided.select("key").distinct(), "key", "left_anti").select("key", "n_rows", "keep_id")
    plain = entries.join(by_key, "key")
    apart = entries.join(collided, ["key", "sha"])
    both = plain.select("doc_id", "keep_id", "n_rows", "sha").unionByName(
        apart.select("doc_id", "keep_id", "n_rows", "sha")
    )
    return both.select(
        "doc_id",
        "keep_id",
        F.col("n_rows").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that repeat both id and text are one document, so one of them stays.
    """
    verdict = settle(exact_groups(docs).where("kept").select("doc_id", "text_sha256"), "verdicts")
    tally = verdict.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("_tw_rows"))
    tally = tally.select(F.col("doc_id").alias("_tw_id"), F.col("text_sha256").alias("_tw_kept"), "_tw_rows")
    marked = docs.withColumn("_tw_sha", F.sha2(normalised(F.col("text")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("_tw_id")) & (F.col("_tw_sha") == F.col("_tw_kept"))
    once = [F.col(f"`{c}`") for c in docs.columns]
    single = marked.join(tally.where("_tw_rows = 1"), same, "left_semi").select(*once)
    repeated = marked.join(tally.where("_tw_rows > 1"), same, "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "_tw_sha"]).select(*once))
