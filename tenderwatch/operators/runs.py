"""Result tables: append-only, one partition per run, beside a table of complete runs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderwatch.sources.manifest import Manifest
from tenderwatch.sources.storage import PACKING

RUNS = "run_id string, computed_at timestamp, n_rows bigint"


@dataclass(frozen=True)
class Results:
    """Results of all runs of one detector, and the list of its complete runs, one row each."""

    rows: DataFrame
    runs: DataFrame


def stamp_run(results: DataFrame, run_id: str, computed_at: datetime | str) -> DataFrame:
    return results.withColumn("run_id", F.lit(run_id)).withColumn(
        "computed_at", F.lit(str(computed_at)).cast("timestamp")
    )


def run_table(spark: SparkSession, path: str) -> Manifest:
    return Manifest(spark, f"{path.rstrip('/')}_runs", RUNS)


def append_run(results: DataFrame, path: str, run_id: str, computed_at: datetime | str) -> None:
    """Append one run, then list it. A run without findings stores nothing and is not listed.

    The run owns its partition: a repeated job overwrites what a lost one has left there, and until
    it is listed nobody reads it.
    """
    spark = results.sparkSession
    folder = f"{path}/run_id={run_id}"
    stamped = stamp_run(results, run_id, computed_at).drop("run_id")
    stamped.write.mode("overwrite").parquet(folder, compression=PACKING)
    n_rows = spark.read.schema(stamped.schema).parquet(folder).count()
    if n_rows:
        moment = F.lit(str(computed_at)).cast("timestamp")
        at = spark.range(1).select(moment.alias("at")).first()["at"]
        run_table(spark, path).put({"run_id": run_id, "computed_at": at, "n_rows": n_rows}, ["run_id"])


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> Results:
    """Results stored under ``path``; no file of them is opened before a run is chosen."""
    runs = run_table(spark, path)
    if not runs.version():
        return Results(spark.createDataFrame([], schema), runs.rows())
    return Results(spark.read.schema(schema).parquet(path), runs.rows())


def latest_run(runs: DataFrame) -> DataFrame:
    """Most recent complete run id, one row, from the list of runs alone."""
    return runs.agg(F.max_by("run_id", F.struct("computed_at", "run_id")).alias("run_id"))


def rows_of_run(results: Results, run_id: str | None = None) -> DataFrame:
    """Rows of the given run if it is complete, or of the latest one; only its partition is scanned."""
    chosen = results.runs.where(F.col("run_id") == run_id) if run_id else results.runs
    return results.rows.where(F.col("run_id") == latest_run(chosen).scalar())


def resolve_run(results: Results, run_id: str | None = None) -> str:
    """The run id to use; an explicit one wins, no run at all is an error."""
    chosen = run_id or latest_run(results.runs).first()["run_id"]
    if chosen is None:
        raise ValueError("no run has been stored yet")
    return chosen
