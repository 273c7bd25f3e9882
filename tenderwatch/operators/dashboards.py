"""Quality metrics and dashboard aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderwatch import schemas as S
from tenderwatch.functions import scoring as C


def quality_metrics(contracts: DataFrame) -> DataFrame:
    """Totals, shares and average confidence in one pass."""
    total = F.col("total")
    return (
        contracts.agg(
            F.count("*").alias("total"),
            F.count_if(~F.col("is_incomplete")).alias("complete"),
            F.count_if("is_incomplete").alias("incomplete"),
            F.count_if("is_suspicious").alias("suspicious"),
            C.round_half_up(
                F.sum("confidence").cast("decimal(28,0)") / F.nullif(F.count("*"), F.lit(0)), 2
            ).alias("avg_confidence"),
        )
        .withColumn("pct_complete", C.pct(F.col("complete"), total))
        .withColumn("pct_incomplete", C.pct(F.col("incomplete"), total))
        .withColumn("pct_suspicious", C.pct(F.col("suspicious"), total))
        .withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(100.0)))
    )


def _missing_counts(contracts: DataFrame) -> DataFrame:
    """Contracts per missing required field, and the total, in one pass without exploding."""
    counts = [
        F.count_if(F.array_contains("missing_fields", f)).alias(f) for f in S.REQUIRED_FIELDS
    ]
    pairs = ", ".join(f"'{f}', {f}" for f in S.REQUIRED_FIELDS)
    return contracts.agg(*counts, F.count("*").alias("total")).selectExpr(
        f"stack({len(S.REQUIRED_FIELDS)}, {pairs}) AS (field, n_missing)", "total"
    )


def missing_field_pct(contracts: DataFrame) -> DataFrame:
    """Count and percentage of contracts per missing field; fields never missing have no row."""
    return (
        _missing_counts(contracts)
        .where("n_missing > 0")
        .select("field", "n_missing", C.pct(F.col("n_missing"), F.col("total")).alias("pct"))
    )


def missing_field_ranking(issues: DataFrame, contracts: DataFrame) -> DataFrame:
    """Stored missing-field issues per field with the share of contracts, most frequent first."""
    total = contracts.agg(F.count("*").alias("n")).scalar()
    return (
        issues.where(F.col("kind") == S.MISSING_FIELD)
        .groupBy("field")
        .agg(F.count("*").alias("n_missing"))
        .withColumn("pct", C.pct(F.col("n_missing"), total))
        .orderBy(F.desc("n_missing"), "field")
    )


def top_missing_fields(issues: DataFrame, contracts: DataFrame, rows: int = 3) -> DataFrame:
    return missing_field_ranking(issues, contracts).limit(rows)


def _by_supplier(contracts: DataFrame, risk: DataFrame) -> DataFrame:
    """Contract counts per supplier with its risk class.

    Contracts are counted per supplier before the join, so a dominant supplier is one row.
    """
    counts = contracts.groupBy("supplier").agg(
        F.count("*").alias("n"),
        F.count_if("is_incomplete").alias("incomplete"),
        F.count_if("is_suspicious").alias("suspicious"),
        F.sum("confidence").alias("confidence"),
    )
    return counts.join(risk.select("supplier", "risk_class"), "supplier", "left")


def _high() -> Column:
    return F.when(F.col("risk_class") == "HIGH", F.col("n")).otherwise(0)


def dashboard_metrics(contracts: DataFrame, risk: DataFrame) -> DataFrame:
    totals = _by_supplier(contracts, risk).agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(a)
            for c, a in (
                (F.col("n"), "total"),
                (F.col("incomplete"), "incomplete"),
                (F.col("suspicious"), "suspicious"),
                (_high(), "high_risk"),
            )
        ],
        F.sum("confidence").alias("confidence"),
    )
    mean = F.col("confidence").cast("decimal(28,0)") / F.nullif(F.col("total"), F.lit(0))
    return totals.select(
        "total",
        "incomplete",
        "suspicious",
        "high_risk",
        C.pct(F.col("incomplete"), F.col("total")).alias("pct_incomplete"),
        C.pct(F.col("suspicious"), F.col("total")).alias("pct_suspicious"),
        C.pct(F.col("high_risk"), F.col("total"), 1).alias("pct_high_risk"),
        F.coalesce(C.round_half_up(mean, 2), F.lit(100.0)).alias("avg_confidence"),
    )


def top_suppliers(contracts: DataFrame, rows: int = 10) -> DataFrame:
    """Suppliers with most contracts, unnamed ones left out."""
    name = F.trim("supplier")
    return (
        contracts.where((name != "") & (F.upper(name) != S.PLACEHOLDER_SUPPLIERS[0]))
        .groupBy(name.alias("supplier"))
        .agg(F.count("*").alias("n_contracts"))
        .orderBy(F.desc("n_contracts"), "supplier")
        .limit(rows)
    )


def risk_distribution(contracts: DataFrame, risk: DataFrame) -> DataFrame:
    """Contracts per class of their supplier; unrated ones count as LOW."""
    return (
        _by_supplier(contracts, risk)
        .groupBy(F.coalesce("risk_class", F.lit("LOW")).alias("risk_class"))
        .agg(F.sum("n").alias("n"))
    )


def _anomaly_totals(contracts: DataFrame, risk: DataFrame, modified: DataFrame) -> DataFrame:
    changed = modified.agg(F.count("*").alias("n")).scalar()
    return (
        _by_supplier(contracts, risk)
        .agg(
            F.sum("incomplete").alias("incomplete"),
            F.sum("suspicious").alias("suspicious"),
            F.sum(_high()).alias("high_risk"),
            F.sum("n").alias("total"),
        )
        .withColumn("modified", changed)
        .selectExpr(
            "stack(4, 'INCOMPLETE', incomplete, 'MODIFIED', modified,"
            " 'SUSPICIOUS', suspicious, 'HIGH_RISK', high_risk) AS (anomaly, n)",
            "total",
        )
    )


def anomaly_distribution(contracts: DataFrame, risk: DataFrame, modified: DataFrame) -> DataFrame:
    return _anomaly_totals(contracts, risk, modified).where("n > 0").select("anomaly", "n")


def anomaly_share(contracts: DataFrame, risk: DataFrame, modified: DataFrame) -> DataFrame:
    """The same counts as whole percentages of all contracts."""
    return (
        _anomaly_totals(contracts, risk, modified)
        .where("n > 0")
        .select("anomaly", "n", C.pct(F.col("n"), F.col("total"), 0).cast("long").alias("pct"))
    )
