"""Filters, sorting, paging and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderwatch import schemas as S
from tenderwatch.functions import normalise as N
from tenderwatch.operators.runs import Results, rows_of_run


def order_columns(column: str, descending: bool, tie: str = "id") -> list[Column]:
    """Sort keys with the relational default for NULLs (last when ascending, first when not)."""
    main = F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)
    return [main] if column == tie else [main, F.asc(tie)]


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 50) -> DataFrame:
    """One page plus the total row and page counts.

    The page is a bounded top-k, the total a separate aggregate of the same filters; neither
    sorts the whole table. The top-k holds all rows up to the page: use ``page_after`` to go deep.
    """
    total = df.agg(F.count("*").alias("total")).scalar()
    return (
        df.orderBy(*order)
        .offset((page - 1) * size)
        .limit(size)
        .withColumn("total", total)
        .withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))
    )


def page_after(
    df: DataFrame, column: str, descending: bool, last: tuple[object, object], size: int = 50, tie: str = "id"
) -> DataFrame:
    """The page after the row whose sort value and id are ``last``; costs the same at any depth.

    The order is that of ``order_columns``, with NULLs where it puts them.
    """
    value, row = F.lit(last[0]), F.lit(last[1])
    key, later = F.col(column), F.col(tie) > row
    if last[0] is None:  # among NULLs: the rest of them, then all values if NULLs come first
        rest = key.isNull() & later
        beyond = rest | key.isNotNull() if descending else rest
    else:
        beyond = ((key < value) if descending else (key > value)) | ((key == value) & later)
        beyond = beyond if descending else beyond | key.isNull()
    return df.where(beyond).orderBy(*order_columns(column, descending, tie)).limit(size)


@dataclass(frozen=True)
class ContractFilter:
    """Optional, AND-ed conditions; text conditions are case-insensitive patterns."""

    buyer: str | None = None
    supplier: str | None = None
    method: str | None = None
    status: str | None = None
    published_from: date | str | None = None
    published_to: date | str | None = None
    value_min: float | None = None
    value_max: float | None = None
    only_incomplete: bool = False
    only_suspicious: bool = False
    confidence_min: int | None = None
    confidence_max: int | None = None

    def conditions(self) -> list[Column]:
        low, high = self.confidence_min, self.confidence_max
        if low is not None and high is not None and low > high:
            raise ValueError("confidence_min is above confidence_max")
        out = []
        for name in ("buyer", "supplier", "method", "status"):
            text = getattr(self, name)
            if text:
                out.append(F.ilike(F.col(name), F.lit(f"%{text}%")))
        ranges = [
            ("published_on", self.published_from, self.published_to, "date"),
            ("total_value", self.value_min, self.value_max, "decimal(20,2)"),
            ("confidence", low, high, "int"),
        ]
        for name, least, most, dtype in ranges:
            if least is not None:
                out.append(F.col(name) >= F.lit(str(least)).cast(dtype))
            if most is not None:
                out.append(F.col(name) <= F.lit(str(most)).cast(dtype))
        if self.only_incomplete:
            out.append(F.col("is_incomplete"))
        if self.only_suspicious:
            out.append(F.col("is_suspicious"))
        return out


def where_all(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    for condition in conditions:
        df = df.where(condition)
    return df


def search_contracts(
    contracts: DataFrame,
    filters: ContractFilter = ContractFilter(),
    sort: str | None = None,
    order: str = "desc",
    page: int = 1,
    size: int = 50,
) -> DataFrame:
    """Filtered, sorted page of contracts; an unknown sort name means publication date."""
    column = S.SORT_FIELDS.get(sort or "fecha", "published_on")
    hits = where_all(contracts, filters.conditions())
    return paginate(hits, order_columns(column, order != "asc"), page, size)


def search_issues(
    issues: DataFrame,
    raw_id: int | Column | None = None,
    contract_id: int | Column | None = None,
    kind: str | None = None,
    field: str | None = None,
) -> DataFrame:
    wanted = {"raw_id": raw_id, "contract_id": contract_id, "kind": kind and kind.upper(), "field": field}
    return where_all(issues, [F.col(c) == v for c, v in wanted.items() if v is not None])


def list_issues(issues: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """Newest first."""
    order = [F.desc_nulls_first("created_at"), F.asc("raw_id"), F.asc("kind"), F.asc("field")]
    return paginate(issues, order, page, size)


def _at_least(column: str, value: float | None) -> list[Column]:
    return [] if value is None else [F.col(column) >= value]


def _at_most(column: str, value: float | None) -> list[Column]:
    return [] if value is None else [F.col(column) <= value]


def _equals(column: str, value: str | None) -> list[Column]:
    return [F.col(column) == value] if value else []


def order_outliers() -> list[Column]:
    return [F.desc_nulls_first("score"), F.asc("contract_id")]


def order_repeats() -> list[Column]:
    return [F.desc_nulls_first("score"), F.asc_nulls_last("days"), F.asc("contract_id")]


def order_direct() -> list[Column]:
    return [F.desc_nulls_first("score"), F.desc_nulls_first("direct_pct"), F.asc("supplier"), F.asc_nulls_last("supplier_tax_id")]


def order_risk() -> list[Column]:
    return [F.desc_nulls_first("final_score"), F.asc("supplier")]


def list_outliers(
    results: Results,
    run_id: str | None = None,
    only_outliers: bool = False,
    group: str | None = None,
    direction: str | None = None,
    min_score: float | None = None,
) -> DataFrame:
    conditions = [F.col("is_outlier")] if only_outliers else []
    conditions += _equals("grp", group) + _equals("direction", direction) + _at_least("score", min_score)
    return where_all(rows_of_run(results, run_id), conditions)


def list_repeats(
    results: Results,
    run_id: str | None = None,
    risk_class: str | None = None,
    min_score: float | None = None,
) -> DataFrame:
    return where_all(
        rows_of_run(results, run_id), _equals("risk_class", risk_class) + _at_least("score", min_score)
    )


def list_direct_awards(
    results: Results,
    run_id: str | None = None,
    risk_class: str | None = None,
    min_score: float | None = None,
    max_score: float | None = None,
    min_pct: float | None = None,
    max_pct: float | None = None,
    only_alerts: bool = False,
) -> DataFrame:
    conditions = (
        _equals("risk_class", risk_class)
        + _at_least("score", min_score)
        + _at_most("score", max_score)
        + _at_least("direct_pct", min_pct)
        + _at_most("direct_pct", max_pct)
    )
    if only_alerts:
        conditions.append(F.col("risk_class").isin("HIGH", "MEDIUM"))
    return where_all(rows_of_run(results, run_id), conditions)


def list_supplier_risk(
    results: Results,
    run_id: str | None = None,
    supplier: str | None = None,
    risk_class: str | None = None,
    min_score: float | None = None,
) -> DataFrame:
    conditions = [F.ilike(F.col("supplier"), F.lit(f"%{supplier}%"))] if supplier else []
    conditions += _equals("risk_class", risk_class) + _at_least("final_score", min_score)
    return where_all(rows_of_run(results, run_id), conditions)


def text_search(contracts: DataFrame, query: str) -> DataFrame:
    """Plain substring of buyer or supplier, any case; no wildcards."""
    q = query.lower()

    def has(name: str) -> Column:
        return F.coalesce(F.lower(name).contains(q), F.lit(False))

    return contracts.where(has("buyer") | has("supplier"))


def autocomplete(contracts: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """First distinct buyer and supplier names that contain the text; two characters at least.

    A name that occurs as both is offered as a buyer.
    """
    q = query.lower()
    names = F.array(
        *[
            F.struct(F.col(column).alias("text"), F.lit(kind).alias("type"))
            for column, kind in (("buyer", "BUYER"), ("supplier", "SUPPLIER"))
        ]
    )
    found = contracts.select(F.explode(names).alias("name")).select("name.*")
    found = found.where(F.lower("text").contains(q) & F.lit(len(query) >= 2))
    return found.groupBy("text").agg(F.min("type").alias("type")).orderBy("text").limit(limit)


def contract_issues(contracts: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues of contracts that are flagged incomplete or suspicious."""
    flagged = contracts.where("is_incomplete OR is_suspicious").select("raw_id")
    return issues.join(flagged, "raw_id", "left_semi")


def modified_contracts(contracts: DataFrame, earlier: DataFrame) -> DataFrame:
    """Contracts whose content differs from an earlier snapshot; hashes move packed."""
    before = earlier.select("raw_id", N.pack_hash(F.col("row_hash")).alias("old_packed"))
    now = contracts.withColumn("packed", N.pack_hash(F.col("row_hash"))).drop("row_hash")
    columns = {c: F.col(c) for c in ["raw_id", *contracts.columns]} | {"row_hash": N.unpack_hash(F.col("packed"))}
    # coalesced: Spark would filter either side by a hash that is not NULL and compute it once more
    changed = now.join(before, "raw_id").where("coalesce(packed <> old_packed, false)")
    return changed.select(*[c.alias(n) for n, c in columns.items()])


def high_risk_contracts(contracts: DataFrame, risk: DataFrame) -> DataFrame:
    """Contracts of suppliers classified HIGH."""
    high = risk.where(F.col("risk_class") == "HIGH").select("supplier")
    return contracts.join(high, "supplier", "left_semi")
