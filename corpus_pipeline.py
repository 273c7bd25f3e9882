"""A training-data pipeline over ``documents``: each stage reads what the one before has kept.

Stages write Parquet to the shared folder and the next one reads it back, so a lost executor costs
one stage at most. All stages but the last return the columns of ``documents``; the last returns
one row per packed piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenderwatch.llm import exact_dedup, packing, secret_ledger, simhash, toxicity
from tenderwatch.llm.common import table
from tenderwatch.llm.queries import WORD_BPE
from tenderwatch.sources.storage import scratch_path, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model finds toxic go; all others stay as they are."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links reach, the one with the smallest id stays."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; no document goes."""
    return secret_ledger.redact(docs, scratch_path(spark, "pipeline-ledger"), length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document and its place in a sequence."""
    return packing.pack_documents(docs, WORD_BPE)[0]


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: the toxicity model and the packing search are beyond SQL; the tests hold stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
