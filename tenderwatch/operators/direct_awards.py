"""Suppliers with concentrated direct awards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderwatch import schemas as S
from tenderwatch.functions import scoring as C
from tenderwatch.operators.outliers import base_filters


def known_suppliers(contracts: DataFrame) -> DataFrame:
    """Contracts whose supplier is neither blank nor a placeholder name."""
    name = F.trim("supplier")
    return contracts.where(
        F.col("supplier").isNotNull() & (name != "") & ~F.upper(name).isin(S.PLACEHOLDER_SUPPLIERS)
    )


def supplier_awards(
    contracts: DataFrame, since: date | str | None = None, until: date | str | None = None
) -> DataFrame:
    """Per supplier and tax id: contract counts and the span of direct awards.

    One aggregation with map-side combine; a supplier with a third of all contracts shuffles
    one row per map task. The descriptive columns are independent maxima.
    """
    direct = C.direct_flag(F.col("method"))
    direct_day = F.when(F.col("direct") == 1, F.col("published_on"))
    return (
        base_filters(known_suppliers(contracts), since=since, until=until)
        .where(F.col("published_on").isNotNull())
        .withColumn("direct", direct)
        .groupBy("supplier", "supplier_tax_id")
        .agg(
            F.count("*").alias("n_contracts"),
            F.sum("direct").alias("n_direct"),
            F.min(direct_day).alias("first_direct"),
            F.max(direct_day).alias("last_direct"),
            F.max("buyer").alias("buyer"),
            F.max("contract_type").alias("contract_type"),
            F.max("method").alias("method"),
            F.max("published_on").alias("contract_date"),
            F.max("id").alias("contract_id"),
        )
    )


def detect_direct_awards(
    contracts: DataFrame,
    since: date | str | None = None,
    until: date | str | None = None,
    min_awards: int = S.DIRECT_MIN_AWARDS,
    span_days: int = S.DIRECT_SPAN_DAYS,
) -> DataFrame:
    """Suppliers with enough direct awards, all of them within the span from first to last."""
    share = C.direct_share(F.col("n_direct"), F.col("n_contracts"))
    return (
        supplier_awards(contracts, since, until)
        .where(F.col("n_direct") >= min_awards)
        .where(F.date_diff("last_direct", "first_direct") <= span_days)
        .withColumn("share", share)
        .select(
            "contract_id",
            "supplier",
            "supplier_tax_id",
            "buyer",
            "contract_type",
            "method",
            "contract_date",
            "n_contracts",
            "n_direct",
            F.col("share").cast("double").alias("direct_pct"),
            C.direct_score(F.col("share")).alias("score"),
            C.direct_class(F.col("share")).alias("risk_class"),
        )
    )


def direct_award_summary(results: DataFrame) -> DataFrame:
    def average(c: str) -> Column:
        return C.round_half_up(F.avg(F.col(c).cast("decimal(20,2)")), 2)

    return results.groupBy("run_id").agg(
        F.count("*").alias("n_suppliers"),
        average("direct_pct").alias("avg_pct"),
        average("score").alias("avg_score"),
        F.min("computed_at").alias("computed_at"),
    )
