"""Landed notices -> stored raw notices: conform, coerce, insert-ignore."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderwatch import schemas as S
from tenderwatch.functions.normalise import stringify_nested
from tenderwatch.operators.scale import first_per_key
from tenderwatch.sources.readers import ARRIVAL


def conform_schema(landed: DataFrame, source_id: int) -> DataFrame:
    """Keep the known columns and the arrival, add absent ones as NULL, stamp the source; nested to text."""
    present = {f.name: f.dataType for f in landed.schema.fields}
    columns = [
        stringify_nested(F.col(n), present[n]).alias(n)
        if n in present
        else F.lit(None).cast("string").alias(n)
        for n, _ in S.NOTICE_FIELDS
    ]
    arrival = [ARRIVAL] if ARRIVAL in landed.columns else []
    return landed.select(F.lit(source_id).cast("int").alias("fuente_id"), *columns, *arrival)


def _coerced(c: Column, dtype: T.DataType) -> Column:
    return c if dtype == T.StringType() else c.try_cast(dtype)


def coerce_types(conformed: DataFrame) -> DataFrame:
    """Text to the stored types; values that cannot be read become NULL."""
    # text gets no alias: the optimizer leaves some in place, and equal exchanges would then seem different
    typed = [
        F.col(n) if t == T.StringType() else _coerced(F.col(n), t).alias(n)
        for n, t in S.NOTICE_FIELDS
        if n in conformed.columns
    ]
    known = {n for n, _ in S.NOTICE_FIELDS}
    return conformed.select(*[c for c in conformed.columns if c not in known], *typed)


def rejected_values(conformed: DataFrame, key: str = S.PROCESS_KEY) -> DataFrame:
    """Values that ``coerce_types`` could not read: ``key, field, value``."""
    bad = [
        F.when(
            F.col(n).isNotNull() & _coerced(F.col(n), t).isNull(),
            F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")),
        )
        for n, t in S.NOTICE_FIELDS
        if n in conformed.columns and t != T.StringType()
    ]
    # rows without any are dropped before the explode
    some = conformed.where(F.coalesce(*bad).isNotNull())
    return some.select(key, F.explode(F.array_compact(F.array(*bad))).alias("bad")).select(key, "bad.*")


def publication_window(
    notices: DataFrame,
    since: date | str | None = None,
    until: date | str | None = None,
    column: str = "fecha_de_publicacion_del",
) -> DataFrame:
    """Notices published from the first instant of one day to the last second of another.

    A plain range on the stored column, so it reaches the Parquet scan; a table written by
    month is pruned to the months of the range. Without a bound nothing is left out; with
    one, undated notices are.
    """
    bounds = []
    by_month = "published_month" in notices.columns
    if since:
        bounds.append(F.col(column) >= F.lit(f"{since} 00:00:00").cast("timestamp"))
        if by_month:
            bounds.append(F.col("published_month") >= str(since)[:7])
    if until:
        bounds.append(F.col(column) <= F.lit(f"{until} 23:59:59").cast("timestamp"))
        if by_month:
            bounds.append(F.col("published_month") <= str(until)[:7])
    kept = notices
    for bound in bounds:
        kept = kept.where(bound)
    return kept


def source_sample(notices: DataFrame) -> DataFrame:
    """Connection test: a source is in order if a small sample of it holds any notice."""
    n = F.count("*")
    return notices.limit(S.SAMPLE_ROWS).agg(
        (n > 0).alias("ok"),
        F.when(n > 0, "connection ok").otherwise("the source is empty").alias("message"),
        n.alias("n_sample"),
    )


def _not_stored(keyed: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet.

    The stored side is first reduced to the keys that arrive. For a small batch Spark
    broadcasts the arriving keys, and the stored table is read once, one column, unshuffled.
    """
    known = stored.select(key).join(keyed.select(key), key, "left_semi")
    return keyed.join(known, key, "left_anti").select(*keyed.columns)


def not_stored(incoming: DataFrame, stored: DataFrame, key: str = S.PROCESS_KEY) -> DataFrame:
    """Incoming rows whose key is not stored yet; rows without a key always pass.

    Those stay out of the join, where they would all meet in one task.
    """
    has_key = F.col(key).isNotNull()
    return _not_stored(incoming.where(has_key), stored, key).unionByName(incoming.where(~has_key))


def insert_ignore(
    incoming: DataFrame, stored: DataFrame, order: Sequence[str], key: str = S.PROCESS_KEY
) -> DataFrame:
    """Rows that an insert with "do nothing on conflict" would add."""
    return first_per_key(incoming, key, order, stored).unionByName(incoming.where(F.col(key).isNull()))


def sync_result(
    incoming: DataFrame,
    inserted: DataFrame,
    since: date | str | None = None,
    until: date | str | None = None,
) -> DataFrame:
    """Fetched, inserted and duplicate counts of one synchronisation."""
    added = inserted.agg(F.count("*").alias("n")).scalar()
    return (
        incoming.agg(F.count("*").alias("fetched"))
        .withColumn("inserted", added)
        .withColumn("duplicates", F.col("fetched") - F.col("inserted"))
        .withColumn("since", F.lit(str(since) if since else None).cast("string"))
        .withColumn("until", F.lit(str(until) if until else None).cast("string"))
    )
