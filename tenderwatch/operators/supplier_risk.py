"""Detector signals combined into one weighted risk class per supplier."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderwatch import schemas as S
from tenderwatch.functions import scoring as C

WEIGHT_SCHEMA = T.StructType(
    [T.StructField("signal", T.StringType()), T.StructField("weight", T.DecimalType(5, 2))]
)


# --- weights -------------------------------------------------------------------------------


def default_weights(spark: SparkSession) -> DataFrame:
    rows = [f"SELECT '{s}' AS signal, CAST({w} AS DECIMAL(5,2)) AS weight" for s, w in S.DEFAULT_WEIGHTS.items()]
    return spark.sql(" UNION ALL ".join(rows))


def seed_weights(stored: DataFrame) -> DataFrame:
    """Stored weights plus the defaults of signals that have none."""
    missing = default_weights(stored.sparkSession).join(stored, "signal", "left_anti")
    return stored.select("signal", "weight").unionByName(missing)


def update_weight(stored: DataFrame, signal: str, weight: float) -> DataFrame:
    """Set one weight; the signal name is case-insensitive and must exist."""
    name = signal.upper()
    if name not in S.DEFAULT_WEIGHTS:
        raise ValueError(f"unknown signal: {signal}")
    if weight < 0:
        raise ValueError("a weight must not be negative")
    changed = F.when(F.col("signal") == name, F.lit(str(weight)).cast("decimal(5,2)"))
    return stored.withColumn("weight", changed.otherwise(F.col("weight")))


def read_weights(stored: DataFrame) -> dict[str, float]:
    """The weight of each of the three signals; of several rows for one, the largest."""
    known = seed_weights(stored).where(F.col("signal").isin(list(S.DEFAULT_WEIGHTS)))
    one = known.groupBy("signal").agg(F.max("weight").alias("weight"))
    return {r["signal"]: float(r["weight"]) for r in one.collect()}


# --- signals -------------------------------------------------------------------------------


def outlier_contracts(outliers: DataFrame) -> DataFrame:
    """Outlier results that have a supplier, reduced to what the risk needs."""
    return outliers.where(F.col("supplier").isNotNull()).select(
        "contract_id", "supplier", "supplier_tax_id", "score"
    )


def supplier_outlier_max(outliers: DataFrame) -> DataFrame:
    return (
        outlier_contracts(outliers)
        .groupBy("supplier", "supplier_tax_id")
        .agg(F.max("score").alias("max_outlier"))
    )


def supplier_repeat_max(repeats: DataFrame) -> DataFrame:
    return (
        repeats.where(F.col("supplier").isNotNull())
        .groupBy("supplier")
        .agg(F.max("score").alias("max_repeat"))
    )


def supplier_direct_max(direct: DataFrame) -> DataFrame:
    return (
        direct.where(F.col("supplier").isNotNull())
        .groupBy("supplier", "supplier_tax_id")
        .agg(F.max("score").alias("direct_score"))
    )


def _signals(outlier_rows: DataFrame, repeats: DataFrame, direct: DataFrame) -> DataFrame:
    """All signal rows in one shape, scores that a row does not carry are NULL."""

    def shaped(df: DataFrame, column: str) -> DataFrame:
        tax_id = F.col("supplier_tax_id") if "supplier_tax_id" in df.columns else F.lit(None).cast("string")
        scores = [
            (F.col("score") if name == column else F.lit(None).cast("double")).alias(name)
            for name in ("max_outlier", "max_repeat", "direct_score")
        ]
        return df.select("supplier", tax_id.alias("supplier_tax_id"), *scores)

    rows = (
        shaped(outlier_rows, "max_outlier")
        .unionByName(shaped(repeats, "max_repeat"))
        .unionByName(shaped(direct, "direct_score"))
    )
    return rows.where("supplier IS NOT NULL AND supplier <> ''")


def supplier_universe(outlier_rows: DataFrame, repeats: DataFrame, direct: DataFrame) -> DataFrame:
    """Distinct (supplier, tax id) over the three signals."""
    return _signals(outlier_rows, repeats, direct).select("supplier", "supplier_tax_id").distinct()


def combine_signals(outlier_rows: DataFrame, repeats: DataFrame, direct: DataFrame) -> DataFrame:
    """Maximum of each signal per supplier name.

    Union and one aggregation give the same rows as left joins of the distinct supplier list
    with the three maxima, but with a single shuffle of map-side combined rows.
    """

    def top(name: str) -> Column:
        return F.coalesce(F.max(name), F.lit(0.0)).alias(name)

    return (
        _signals(outlier_rows, repeats, direct)
        .groupBy("supplier")
        .agg(
            F.max("supplier_tax_id").alias("supplier_tax_id"),
            top("max_outlier"),
            top("max_repeat"),
            top("direct_score"),
        )
    )


def score_risk(signals: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum, class on the exact sum, scores stored with two digits."""

    def part(column: str, signal: str) -> Column:
        return F.col(column) * F.lit(float(weights[signal]))

    total = (
        part("max_outlier", "OUTLIER")
        + part("max_repeat", "SHORT_REPEAT")
        + part("direct_score", "DIRECT_AWARD")
    )
    pairs = [x for s in sorted(weights) for x in (F.lit(s), F.lit(float(weights[s])))]
    exact = total.cast("decimal(38,10)")
    return signals.select(
        "supplier",
        "supplier_tax_id",
        "max_outlier",
        "max_repeat",
        "direct_score",
        C.round_half_up(total, 2).alias("final_score"),
        C.combined_class(exact).alias("risk_class"),
        F.create_map(*pairs).alias("weights"),
    )


def combine_supplier_risk(
    outliers: DataFrame,
    repeats: DataFrame,
    direct: DataFrame,
    weights: Mapping[str, float],
) -> DataFrame:
    """Combined risk from one run of each detector and the current weights: one aggregation, no join."""
    rows = outlier_contracts(outliers)
    return score_risk(combine_signals(rows, repeats, direct), weights)


def risk_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id").agg(
        F.count("*").alias("n_suppliers"),
        C.round_half_up(F.avg(F.col("final_score").cast("decimal(20,2)")), 2).alias("avg_score"),
        F.min("computed_at").alias("computed_at"),
    )
