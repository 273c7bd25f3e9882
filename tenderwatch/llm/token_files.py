"""Token ids as Parquet list columns, in files that allow selective reads.

Documents are dealt by range of ``doc_id``, encoded, and written in ascending order. The id lists
are dictionary-encoded (ids are few and skewed towards small ranks), the metadata columns are
delta-encoded by the second version of the format; row groups and pages are kept small, and page
indexes let a reader fetch the pages of one document or the metadata alone.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderwatch.llm.common import Batches, in_python
from tenderwatch.llm.tokens import END_ID, encoder

#: bytes of a row group, of a page, and rows of a page at most
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000
#: about the bytes of text encoded at a time: more repeat more words, fewer take less memory
_STEP_BYTES = 4 << 20


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of documents whose texts are bounded; a longer text goes with its neighbours at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // _STEP_BYTES)) + 1
    for a, b in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def _encode(path: str) -> Callable[[Batches], Batches]:
    def task(batches: Batches) -> Batches:
        for batch in batches:
            for part in _steps(batch):
                end = np.array([END_ID], "<u4").tobytes()
                encoded = [x + end for x in encoder(path).encode(part.column(1).to_pylist())]
                # else Arrow keeps what the stretch took, in every worker
                pa.default_memory_pool().release_unused()
                lengths = np.array([len(x) // 4 for x in encoded], np.int64)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                values = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lengths), ids], ["doc_id", "n_tokens", "ids"]
                )

    return task


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write ``doc_id, n_tokens, ids`` of every document to ``path``, ascending by ``doc_id``.

    ``ids`` are those of the whole text plus the end id; NULL counts as empty, so every row has at
    least the end id. A NULL ``doc_id`` comes first; rows that repeat an id lie side by side. File
    names ascend with the ids. Extra columns are never read; an empty table leaves no rows.
    """
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encoded = in_python(ordered, _encode(tokenizer_path), f"doc_id {id_type}, n_tokens long, ids array<int>")
    writer = encoded.withColumn("range", F.spark_partition_id()).write
    for name, value in (
        ("writer.version", "v2"),
        ("block.size", ROW_GROUP_BYTES),
        ("page.size", PAGE_BYTES),
        ("page.row.count.limit", PAGE_ROWS),
        ("enable.dictionary", "true"),
        ("enable.dictionary#doc_id", "false"),
        ("enable.dictionary#n_tokens", "false"),
    ):
        writer = writer.option(f"parquet.{name}", value)
    writer.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    schema = T.StructType.fromDDL(f"doc_id {id_type}, n_tokens long, ids array<int>, range int")
    return spark.read.schema(schema).parquet(path)


def starts(tokens: DataFrame) -> DataFrame:
    """``range, before``: ids in all files before each range, from the metadata columns alone."""
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = tokens.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    return sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _crc(batches: Batches) -> Batches:
    for batch in batches:
        ids = batch.column(2)
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        ends = ids.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(crcs, pa.int64()), batch.column(3)],
            ["doc_id", "n_tokens", "ids_crc32", "range"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of token files, read back.

    ``start`` counts the ids of all documents before in ascending ``doc_id`` order: the sum of the
    ranges before, which is one number per range, and a running sum inside the range.
    """
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    read = tokens.select("doc_id", "n_tokens", "ids", "range")
    crcs = in_python(read, _crc, f"doc_id {id_type}, n_tokens long, ids_crc32 long, range int")
    inside = Window.partitionBy("range").orderBy("doc_id", "n_tokens", "ids_crc32")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        crcs.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(starts(tokens), "range")
        .select("doc_id", (F.col("before") + F.col("_inside")).alias("start"), "n_tokens", "ids_crc32")
    )
