"""Scores and classes of the detectors.

Classes are decided on unrounded values, rounding happens afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderwatch import schemas as S


def round_half_up(c: Column, digits: int) -> Column:
    """Decimal rounding, so that the result does not depend on binary representation."""
    return F.round(c.cast("decimal(38,10)"), digits).cast("double")


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole * 100`` rounded; 0 when there is nothing to divide by."""
    share = part.cast("decimal(20,0)") * 100 / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.coalesce(F.round(share, digits).cast("double"), F.lit(0.0))


def group_key(method: Column, contract_type: Column) -> Column:
    def filled(c: Column) -> Column:
        return F.nullif(F.trim(c), F.lit(""))

    return F.coalesce(filled(method), filled(contract_type))


def lower_fence(q1: Column, iqr: Column) -> Column:
    return q1 - F.lit(S.IQR_FACTOR) * iqr


def upper_fence(q3: Column, iqr: Column) -> Column:
    return q3 + F.lit(S.IQR_FACTOR) * iqr


def outlier_direction(v: Column, lower: Column, upper: Column) -> Column:
    return F.when(v > upper, "HIGH").when(v < lower, "LOW")


def outlier_score(v: Column, lower: Column, upper: Column, iqr: Column) -> Column:
    distance = F.when(v > upper, v - upper).when(v < lower, lower - v)
    return round_half_up(F.coalesce(distance / iqr, F.lit(0.0)), 4)


def repeat_score(days: Column) -> Column:
    step = S.REPEAT_MAX_SCORE / S.REPEAT_DAYS
    return round_half_up(F.greatest(F.lit(0.0), F.lit(S.REPEAT_MAX_SCORE) - days * F.lit(step)), 2)


def repeat_class(days: Column) -> Column:
    return (
        F.when(days <= S.REPEAT_HIGH_DAYS, "HIGH")
        .when(days <= S.REPEAT_MEDIUM_DAYS, "MEDIUM")
        .otherwise("LOW")
    )


def direct_flag(method: Column) -> Column:
    return F.when(F.lower(method).contains("directa"), 1).otherwise(0)


def direct_share(direct: Column, total: Column) -> Column:
    """Percentage of direct awards as DECIMAL, two digits; NULL without contracts."""
    ratio = direct.cast("decimal(20,0)") * 100 / F.nullif(total, F.lit(0)).cast("decimal(20,0)")
    return F.round(ratio, 2)


def direct_score(share: Column) -> Column:
    return round_half_up(share / 10, 2)


def direct_class(share: Column) -> Column:
    return (
        F.when(share >= S.DIRECT_HIGH_PCT, "HIGH")
        .when(share >= S.DIRECT_MEDIUM_PCT, "MEDIUM")
        .otherwise("LOW")
    )


def combined_class(score: Column) -> Column:
    return (
        F.when(score >= S.RISK_HIGH_SCORE, "HIGH")
        .when(score >= S.RISK_MEDIUM_SCORE, "MEDIUM")
        .otherwise("LOW")
    )


def seconds_between(started: Column, ended: Column) -> Column:
    """Whole seconds from start to end, NULL while open."""
    micros = F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.round(micros / F.lit(1_000_000.0)).cast("long")


def elapsed_days(since: Column, now: Column) -> Column:
    """Completed 24-hour periods between two instants."""
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(since.cast("timestamp"))
    return F.floor(seconds / 86400)
