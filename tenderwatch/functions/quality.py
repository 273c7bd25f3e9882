"""Record-quality rules on raw notices."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderwatch import schemas as S
from tenderwatch.functions.normalise import is_blank

_TYPES = dict(S.NOTICE_FIELDS)


def is_missing(field: str) -> Column:
    c = F.col(field)
    return is_blank(c) if _TYPES[field] == T.StringType() else c.isNull()


def is_future(field: str, as_of: Column) -> Column:
    return F.coalesce(F.to_date(field) > as_of, F.lit(False))


def is_negative(field: str) -> Column:
    return F.coalesce(F.col(field) < 0, F.lit(False))


def missing_fields(values: Mapping[str, Column]) -> Column:
    """Names of the required fields whose normalised value is NULL, in their fixed order."""
    names = [F.when(values[f].isNull(), F.lit(f)).otherwise("") for f in S.REQUIRED_FIELDS]
    return F.array_remove(F.array(*names), "")


def _any(test: Callable[[str], Column], fields: list[str]) -> Column:
    result = F.lit(False)
    for field in fields:
        result = result | test(field)
    return result


def has_negative_amount() -> Column:
    return _any(is_negative, S.AMOUNT_FIELDS)


def has_future_date(as_of: Column) -> Column:
    return _any(lambda f: is_future(f, as_of), S.FUTURE_DATE_FIELDS)


def confidence(n_missing: Column, negative: Column, future: Column) -> Column:
    score = (
        F.lit(100)
        - n_missing * S.PENALTY_MISSING
        - F.when(negative, S.PENALTY_NEGATIVE).otherwise(0)
        - F.when(future, S.PENALTY_FUTURE).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def _issue(kind: str, field: str, value: Column, description: str) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(field).alias("field"),
        value.cast("string").alias("original_value"),
        F.lit(description).alias("description"),
    )


def missing_issues() -> list[Column]:
    return [
        F.when(
            is_missing(f),
            _issue(S.MISSING_FIELD, f, F.lit(None), f"The contract has no {f}"),
        )
        for f in S.REQUIRED_FIELDS
    ]


def future_date_issues(as_of: Column) -> list[Column]:
    text = "The contract has an invalid future date"
    return [
        F.when(
            is_future(f, as_of),
            _issue(S.FUTURE_DATE, f, F.date_format(f, "yyyy-MM-dd HH:mm:ss"), text),
        )
        for f in S.FUTURE_DATE_FIELDS
    ]


def negative_amount_issues() -> list[Column]:
    text = "The contract has a negative amount"
    return [
        F.when(is_negative(f), _issue(S.NEGATIVE_AMOUNT, f, F.col(f), text))
        for f in S.AMOUNT_FIELDS
    ]


def all_issues(as_of: Column) -> list[Column]:
    """Every possible issue of one notice, NULL where it does not apply."""
    return [*missing_issues(), *future_date_issues(as_of), *negative_amount_issues()]
