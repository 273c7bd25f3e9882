"""Contracts of the same supplier, buyer and kind within a short period."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderwatch import schemas as S
from tenderwatch.functions import scoring as C
from tenderwatch.operators.outliers import base_filters
from tenderwatch.operators.scale import TASK_ROWS, previous_in_key


def repeat_scope(
    contracts: DataFrame, since: date | str | None = None, until: date | str | None = None
) -> DataFrame:
    """Complete contracts with supplier, buyer and publication date."""
    return (
        base_filters(contracts, since=since, until=until)
        .where("supplier IS NOT NULL AND buyer IS NOT NULL AND published_on IS NOT NULL")
        .where(~F.col("is_incomplete"))
        .select("id", "supplier", "buyer", "contract_type", "method", "published_on")
    )


def lag_pairs(scope: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Every contract with the preceding one of the same supplier, buyer and kind."""
    kind = F.coalesce("contract_type", "method")
    pairs = previous_in_key(
        scope.withColumn("kind", kind), ["supplier", "buyer", "kind"], "published_on", "id", task_rows
    )
    return pairs.drop("kind").withColumn("days", F.date_diff("published_on", "prev_on"))


def detect_repeats(
    contracts: DataFrame,
    since: date | str | None = None,
    until: date | str | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Pairs at most 30 days apart, scored and classified by the gap."""
    days = F.col("days")
    return (
        lag_pairs(repeat_scope(contracts, since, until), task_rows)
        .where(days <= S.REPEAT_DAYS)
        .select(
            F.col("id").alias("contract_id"),
            F.col("prev_id").alias("related_id"),
            "supplier",
            "buyer",
            "contract_type",
            "method",
            F.col("published_on").alias("contract_date"),
            F.col("prev_on").alias("related_date"),
            "days",
            C.repeat_score(days).alias("score"),
            C.repeat_class(days).alias("risk_class"),
        )
    )


def repeat_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(
        F.count("*").alias("n_pairs"),
        C.round_half_up(F.sum("days") / F.count("*"), 2).alias("avg_days"),
        C.round_half_up(F.avg(F.col("score").cast("decimal(20,2)")), 2).alias("avg_score"),
        F.min("computed_at").alias("computed_at"),
    )


def count_by_class(results: DataFrame) -> DataFrame:
    """Rows per risk class, most frequent first."""
    return (
        results.groupBy("risk_class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "risk_class")
    )
