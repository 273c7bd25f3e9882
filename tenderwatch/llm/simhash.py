"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared as numpy arrays, tile against tile, by exclusive-or and bit counts. A
tile holds fingerprints with the same population counts of their two halves, and the counts of two
fingerprints never differ by more than their bits do, so tile pairs whose counts differ by more
than the radius are never formed. Every other pair of tiles is compared in full: no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderwatch.llm.common import Batches, components, forest, in_python, shuffle_partitions
from tenderwatch.sources.storage import settle

SEED = 42
SHINGLE_WORDS = 4
RADIUS = 4
#: fingerprints in a tile, about; 32 KB
TILE = 4096
#: rows of a tile compared at a time with the whole other tile
_STRIP = 64
#: shingle hashes whose bits are counted at a time
_CHUNK = 1 << 14


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(view[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64 majority bits of the text's shingle hashes, as a signed integer; 0 without words."""
    h = _shingle_hashes(text, width)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(packed.view("<i8")[0])


def _fingerprints(batches: Batches) -> Batches:
    for batch in batches:
        prints = [fingerprint(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row, from the whole text; NULL counts as empty."""
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return in_python(rows, _fingerprints, f"doc_id {id_type}, fp long")


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.bit_count(F.shiftrightunsigned(fp, 32)), F.bit_count(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def tiles(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """``hi, lo, part, fps``: distinct fingerprints by the population counts of their halves."""
    high, low = _halves(F.col("fp"))
    cells = prints.select("fp", high.alias("hi"), low.alias("lo"))
    # 33 x 33 cells at most, so their sizes can always be broadcast
    sizes = cells.groupBy("hi", "lo").agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts"))
    return (
        cells.join(F.broadcast(sizes), ["hi", "lo"])
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .groupBy("hi", "lo", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )


def _compare(batches: Batches, radius: int) -> Batches:
    for batch in batches:
        for mine, other, same in zip(*(batch.column(i) for i in range(3))):
            a = mine.values.to_numpy(zero_copy_only=False)
            b = other.values.to_numpy(zero_copy_only=False)
            kept: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
            for at in range(0, len(a), _STRIP):
                strip = a[at : at + _STRIP]
                against = b[at:] if same.as_py() else b
                i, j = np.nonzero(np.bitwise_count((strip[:, None] ^ against[None, :]).view(np.uint64)) <= radius)
                one, two = strip[i], against[j]
                real = one != two
                if real.any():
                    kept = forest(np.concatenate((kept[0], one[real])), np.concatenate((kept[1], two[real])))
            if len(kept[0]):
                yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1])], ["a", "b"])


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints within ``radius``, a forest per tile pair."""
    tiled = settle(tiles(prints, tile), "tiles")
    shifts = [
        (x, y)
        for x in range(0, radius + 1)
        for y in range(-radius, radius + 1)
        if x + abs(y) <= radius and (x > 0 or y >= 0)
    ]
    moves = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in shifts])
    near = tiled.select("hi", "lo", "part").withColumn("to", F.explode(moves))
    near = near.select(
        F.col("hi").alias("hi_a"), F.col("lo").alias("lo_a"), F.col("part").alias("part_a"),
        (F.col("hi") + F.col("to.x")).alias("hi"), (F.col("lo") + F.col("to.y")).alias("lo"),
    )
    same_cell = (F.col("hi_a") == F.col("hi")) & (F.col("lo_a") == F.col("lo"))
    pairs = near.join(tiled.select("hi", "lo", "part"), ["hi", "lo"]).where(
        ~same_cell | (F.col("part_a") <= F.col("part"))
    )
    left = tiled.select(*[F.col(c).alias(f"{c}_a") for c in tiled.columns])
    both = (
        pairs.repartition(shuffle_partitions(prints.sparkSession), *pairs.columns)
        .join(left, ["hi_a", "lo_a", "part_a"])
        .join(tiled, ["hi", "lo", "part"])
        .select("fps_a", "fps", (same_cell & (F.col("part_a") == F.col("part"))).alias("same"))
    )
    return in_python(both, lambda batches: _compare(batches, radius), "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; the component id is
    the smallest ``doc_id`` that links reach. Texts without words have fingerprint zero and link
    like any other. Copies collapse to one fingerprint before any comparison. A row whose
    ``doc_id`` is NULL gets its group's id, NULL if the group has no other; repeated rows come back
    each. An empty table gives an empty result; other columns are never read.
    """
    rows = settle(fingerprints(docs), "fingerprints")
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    tied = settle(components(links(prints.select("fp"), radius, tile)), "components")
    group = F.coalesce(F.col("component"), F.col("fp"))
    rooted = prints.join(tied, F.col("fp") == F.col("node"), "left").select("fp", "first_id", group.alias("group"))
    firsts = rooted.groupBy("group").agg(F.min("first_id").alias("component_id"))
    named = settle(rooted.join(firsts, "group").select("fp", "component_id"), "groups")
    return rows.join(named, "fp").select(
        "doc_id", _in_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Rows without an id are never dropped here. Where rows of one id have texts of different groups,
    each row is judged by its own text.
    """
    groups = settle(near_groups(docs), "near-groups")
    lesser = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_tw_id"), F.col("fingerprint").alias("_tw_print")).distinct()
    kinds = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.countDistinct("fingerprint").alias("n"))
    several = settle(kinds.where("n > 1").select(F.col("doc_id").alias("_tw_id")), "ids-of-several-texts")
    if several.isEmpty():
        return docs.join(lesser, F.col("doc_id") == F.col("_tw_id"), "left_anti")
    same_id = F.col("doc_id") == F.col("_tw_id")
    plain = docs.join(several, same_id, "left_anti").join(lesser, same_id, "left_anti")
    doubtful = docs.join(several, same_id, "left_semi").withColumn("_tw_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = doubtful.select(F.col("_tw_sha").alias("_tw_of"), "text").dropDuplicates(["_tw_of"])
    texts = settle(texts.withColumn("doc_id", F.monotonically_increasing_id()), "doubtful-texts")
    prints = fingerprints(texts.select("doc_id", "text")).select("doc_id", _in_hex(F.col("fp")).alias("_tw_is"))
    prints = texts.select("doc_id", "_tw_of").join(prints, "doc_id").drop("doc_id")
    judged = doubtful.join(prints, F.col("_tw_sha") == F.col("_tw_of"))
    kept = judged.join(lesser, same_id & (F.col("_tw_is") == F.col("_tw_print")), "left_anti")
    return plain.unionByName(kept.select(*[F.col(f"`{c}`") for c in docs.columns]))


def _in_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
