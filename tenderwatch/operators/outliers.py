"""Value outliers per contracting method by interquartile range."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderwatch import schemas as S
from tenderwatch.functions import scoring as C
from tenderwatch.operators.scale import TASK_ROWS, exact_quantiles
from tenderwatch.sources.storage import settle


def base_filters(
    contracts: DataFrame,
    date_field: str = "published_on",
    since: date | str | None = None,
    until: date | str | None = None,
    method: str | None = None,
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """Optional date range on an accepted date column and exact method filters."""
    if date_field not in S.DATE_FIELDS:
        raise ValueError(f"not a date field: {date_field}")
    out = contracts
    if since:
        out = out.where(F.col(date_field) >= F.lit(str(since)).cast("date"))
    if until:
        out = out.where(F.col(date_field) <= F.lit(str(until)).cast("date"))
    if methods:
        out = out.where(F.col("method").isin(list(methods)))
    if method:
        out = out.where(F.col("method") == method)
    return out


def valid_contracts(contracts: DataFrame, field: str = "total_value", **filters) -> DataFrame:
    """Complete contracts with a positive value: ``contract_id, grp, value`` and the supplier."""
    if field not in S.NUMERIC_FIELDS:
        raise ValueError(f"not a numeric field: {field}")
    value = F.col(field)
    return (
        base_filters(contracts, **filters)
        .where(~F.col("is_incomplete") & value.isNotNull() & (value > 0))
        .select(
            F.col("id").alias("contract_id"),
            C.group_key(F.col("method"), F.col("contract_type")).alias("grp"),
            value.cast("double").alias("value"),
            "supplier",
            "supplier_tax_id",
        )
    )


def group_quartiles(valid: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Quartiles and fences per group; groups without spread are left out."""
    return (
        exact_quantiles(valid, "grp", "value", [0.25, 0.75], task_rows)
        .select("grp", F.col("n_rows").alias("n"), F.col("q0").alias("q1"), F.col("q1").alias("q3"))
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .withColumn("lower", C.lower_fence(F.col("q1"), F.col("iqr")))
        .withColumn("upper", C.upper_fence(F.col("q3"), F.col("iqr")))
        .where("iqr > 0")
    )


def classify(valid: DataFrame, stats: DataFrame, field: str) -> DataFrame:
    """Each contract against the fences of its group; one row per analysed contract."""
    direction = C.outlier_direction(F.col("value"), F.col("lower"), F.col("upper"))
    score = C.outlier_score(F.col("value"), F.col("lower"), F.col("upper"), F.col("iqr"))
    return valid.join(stats, "grp").select(
        "contract_id",
        "grp",
        F.lit(field).alias("field"),
        "value",
        "q1",
        "q3",
        "iqr",
        "lower",
        "upper",
        direction.isNotNull().alias("is_outlier"),
        direction.alias("direction"),
        score.alias("score"),
        "supplier",
        "supplier_tax_id",
    )


def detect_outliers(
    contracts: DataFrame, field: str = "total_value", task_rows: int = TASK_ROWS, **filters
) -> DataFrame:
    """The whole detector. The statistics are stored first, so the join knows their size."""
    valid = valid_contracts(contracts, field, **filters)
    stats = settle(group_quartiles(valid, task_rows).drop("n"), "group-stats")
    return classify(valid, stats, field)


def run_summary(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("run_id", "field")
        .agg(
            F.count("*").alias("n_analysed"),
            F.count_if("is_outlier").alias("n_outliers"),
            F.count_if(F.col("direction") == "HIGH").alias("n_high"),
            F.count_if(F.col("direction") == "LOW").alias("n_low"),
            F.count_distinct("grp").alias("n_groups"),
            F.min("computed_at").alias("computed_at"),
        )
        .withColumn("pct_outliers", C.pct(F.col("n_outliers"), F.col("n_analysed")))
    )


def group_summary(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("grp")
        .agg(
            *[F.max(c).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")],
            F.count("*").alias("n_analysed"),
            F.count_if("is_outlier").alias("n_outliers"),
            F.count_if(F.col("direction") == "HIGH").alias("n_high"),
            F.count_if(F.col("direction") == "LOW").alias("n_low"),
        )
        .orderBy(F.desc("n_outliers"), "grp")
    )
